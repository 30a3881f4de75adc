"""The bound against the target weights themselves, on long mixtures and with more sources than the driver lays out."""

from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from causeway.llm import edf, mixing


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.5, **{f"s{i:02}": 0.5 / 19 for i in range(19)}}, {"a": 0.123457, "b": 2.0, "c": 1 / 3}])
def test_bound_against_the_weights_given(weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    blocks = {k: int(30_000 * w) + 5 for k, w in weights.items()}
    plan = mixing.phases(blocks, weights, None)
    assert {k: sum(p["took"].get(k, 0) for p in plan) for k in blocks} == blocks
    p, order = plan[0], {}
    for k, at in p["at"].items():
        for j in range(p["took"][k]):
            order[j // len(at) * p["period"] + at[j % len(at)]] = k
    assert sorted(order) == list(range(len(order))) and len(order) > 20_000
    seen = dict.fromkeys(weights, 0)
    for t in range(len(order)):
        seen[order[t]] += 1
        assert all(abs(seen[k] - (t + 1) * Fraction(str(w)) / total) < 1 for k, w in weights.items()) if t % 97 == 0 else True


def test_units_have_no_bias():
    assert mixing.units({"a": 0.9, "b": 0.1}, 1000) == {"a": 900, "b": 100}
    assert mixing.units({"a": 0.5, **{f"s{i}": 0.5 / 19 for i in range(19)}}, 1000)["a"] == 500
    few = mixing.units({"a": 1e9, "b": 1.0, "c": 1.0}, 10)
    assert few == {"a": 8, "b": 1, "c": 1}


@pytest.mark.parametrize("given", [False, True])
def test_pooled_sources_keep_their_weights(docs_of, monkeypatch, given):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    names = [f"s{i}" for i in range(9)]
    docs = docs_of([(100 * i + n, "t", "en", s) for i, s in enumerate(names) for n in range(60)])
    weights = {s: 8.0 if i < 3 else 4.0 if i < 5 else 1.0 for i, s in enumerate(names)} if given else None
    rows = mixing.mix(docs, weights, block_rows=2, period=90).collect()
    assert len(rows) == 540 and len({r.position for r in rows}) == 540
    assert {r.mix_source for r in rows} == {f"s:{s}" for s in names}
    first = sorted({(r.slot, r.mix_source) for r in rows if r.phase == 0})
    assert [t for t, _ in first] == list(range(len(first)))
    share = {f"s:{s}": (weights[s] if given else 1) / (sum(weights.values()) if given else 9) for s in names}
    seen = dict.fromkeys(share, 0)
    for t, (_, k) in enumerate(first, 1):
        seen[k] += 1
        assert all(abs(seen[s] - t * share[s]) < 2 for s in share)


def test_three_hundred_sources_keep_their_weights(docs_of):
    """All of them are laid out one by one, within a block of the weights given."""
    names = [f"s{i:03}" for i in range(300)]
    weights = {s: 1 + i % 7 for i, s in enumerate(names)}
    rows = [(1000 * i + n, "t", "en", s) for i, s in enumerate(names) for n in range(weights[s] * 3)]
    placed = mixing.mix(docs_of(rows), weights, block_rows=1).collect()
    assert len(placed) == len(rows)
    order = [r.mix_source[2:] for r in sorted(placed, key=lambda r: r.position)]
    total, seen = sum(weights.values()), dict.fromkeys(names, 0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        if t % 11 == 0:
            assert all(abs(seen[k] - Fraction(t * w, total)) < 1 for k, w in weights.items())


def one_by_one(names, blocks, weights):
    """All slots by one heap over windows made of fractions."""
    import bisect
    import heapq

    ends = sorted((Fraction(blocks[k], weights[k]), k) for k in names)
    gone, stopped = [0], [0]
    for _, k in ends:
        gone.append(gone[-1] + blocks[k])
        stopped.append(stopped[-1] + weights[k])
    flow = {}
    for k in names:
        for j in range(blocks[k] + 1):
            i = bisect.bisect_left(ends, (Fraction(j, weights[k]), ""))
            flow[k, j] = gone[i] + Fraction(j * (stopped[-1] - stopped[i]), weights[k])
    todo = sorted((flow[k, j] // 1, -(-flow[k, j + 1] // 1), k, j) for k in names for j in range(blocks[k]))
    ready, out = [], {}
    for t in range(len(todo)):
        while todo and todo[0][0] <= t:
            _, d, k, j = todo.pop(0)
            heapq.heappush(ready, (d, k, j))
        d, k, j = heapq.heappop(ready)
        assert t < d
        out[k, j] = t
    return out, ends


@pytest.mark.parametrize("slots", [64, 997, 1 << 18])
def test_segments_give_the_one_schedule(spark, slots):
    names = [f"s{i:03}" for i in range(150)]
    blocks = {k: 900 if i == 0 else 1 + i * 7 % 23 for i, k in enumerate(names)}
    weights = {k: 1 + i * i % 41 if i else 500 for i, k in enumerate(names)}
    sources = spark.createDataFrame([(k, blocks[k], weights[k]) for k in names], "name string, blocks long, weight long")
    got = edf.schedule(edf.windows(sources), slots).collect()
    want, ends = one_by_one(names, blocks, weights)
    assert len(got) == sum(blocks.values()) and {(r.name, r.block): r.slot for r in got} == want
    assert [r.phase for r in sorted(got, key=lambda r: r.slot)] == sorted(r.phase for r in got)
    assert edf.schedule(edf.windows(sources.limit(0)), slots).count() == 0


def test_chunks_of_a_heavy_source(spark, monkeypatch):
    monkeypatch.setattr(edf, "CHUNK", 7)
    sources = spark.createDataFrame([("a", 21, 3), ("b", 7, 1), ("c", 1, 1)], "name string, blocks long, weight long")
    got = edf.windows(sources).collect()
    assert sorted((r.name, r.block) for r in got) == [("a", j) for j in range(21)] + [("b", j) for j in range(7)] + [("c", 0)]
    assert all(r.release < r.deadline for r in got) and [r.name for r in got if r.last].__len__() == 3
    assert sorted(r.slot for r in edf.schedule(edf.windows(sources), 4).collect()) == list(range(29))


@pytest.mark.parametrize("given", [False, True])
def test_two_thousand_sources_within_a_block_of_their_weights(spark, given):
    """Sources of sizes and weights of many kinds, one with a quarter of all rows: less than a block from the targets until one runs out."""
    n = 2000
    docs = spark.range(n).select(F.col("id").alias("k"), (20 + F.col("id") * 7 % 31).alias("rows")).withColumn("rows", F.when(F.col("k") == 0, 20_000).otherwise(F.col("rows")))
    docs = docs.select(F.concat(F.lit("s"), "k").alias("source"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("i"), "k", "rows")
    docs = docs.select((F.col("k") * 100_000 + F.col("i")).alias("doc_id"), "source")
    size = {f"s{k}": 20_000 if k == 0 else 20 + k * 7 % 31 for k in range(n)}
    weights = {s: 0.5 + (int(s[1:]) * 13 % 97) / 8 for s in size} if given else None
    rows = mixing.mix(docs, weights, block_rows=1).collect()
    assert len(rows) == sum(size.values()) and sorted(r.position for r in rows) == list(range(len(rows)))
    target = {s: Fraction(str(weights[s])) if given else Fraction(round(size[s] ** mixing.TEMPERATURE * mixing.UNITS)) for s in size}
    total, seen = sum(target.values()), dict.fromkeys(size, 0)
    order = [r.mix_source[2:] for r in sorted(rows, key=lambda r: r.position) if r.phase == 0]
    assert len(order) > 10_000
    for t, s in enumerate(order, 1):
        seen[s] += 1
        if t % 499 == 0:
            assert all(abs(seen[k] - t * w / total) < 1 for k, w in target.items())
