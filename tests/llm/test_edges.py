"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random

import numpy as np
import pytest
from llm_helpers import brute_components
from pyspark.sql import functions as F

from causeway.llm import exact_dedup, html_extract, langid, mixing, near_dedup, pii, quality, sentencepiece_codec, substring_dedup, topk
from causeway.llm.components import components

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG + " tail"), (None, "null id text that is here"), (7, "One"), (4, "one"), (8, "é ü ünï")]


@pytest.fixture(scope="module")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="module")
def none(docs_of):
    return docs_of([])


def test_exact(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.digest, []).append(r)
    empty = next(g for g in by.values() if any(r.doc_id == 1 for r in g))
    assert sorted(r.doc_id for r in empty) == [1, 2] and all(r.keep_id == 2 and r.group_size == 2 for r in empty)
    ones = next(g for g in by.values() if any(r.doc_id == 7 for r in g))
    assert sorted(r.doc_id for r in ones) == [4, 4, 7] and [r.doc_id for r in ones if r.kept] == [7]
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)


def test_exact_keeps_one_of_repeated_rows(docs_of):
    df = docs_of([(1, "a b"), (1, "a b"), (2, "c"), (None, "a B"), (None, "d"), (None, "D")])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in exact_dedup.drop_copies(df).collect()) == [(False, 1), (False, 2), (True, 0)]


def test_exact_hot_digest_and_session(spark, docs_of):
    """A digest that most rows share, and one that none does; the session keeps its settings."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    rows = exact_dedup.exact_dedup(docs_of([(i, "Same" if i % 2 else "same") for i in range(200)] + [(i, f"t{i // 2}") for i in range(200, 240)])).collect()
    assert len(rows) == 240 and [r.doc_id for r in rows if r.kept and r.doc_id < 200] == [199]
    assert all(r.group_size == (200 if r.doc_id < 200 else 2) for r in rows) and spark.conf.get(key) == before
    assert len({r.locator for r in rows}) == 240


def test_exact_lowers_ascii_only(docs_of):
    df = docs_of([(1, "É"), (2, "é"), (3, "Aİ"), (4, "aİ"), (5, "ß"), (6, "SS")])
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()} == {1: 1, 2: 2, 3: 4, 4: 4, 5: 5, 6: 6}


def test_exact_state_survives_several_batches(spark, docs_of, tmp_path):
    prints = exact_dedup.fingerprints(exact_dedup.located(docs_of([(i, f"t{i % 3}") for i in range(9)])))
    schema = prints.schema
    for lo in (0, 5):
        prints.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 5)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = exact_dedup.run_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/cp")
    assert sorted((r.n, r.keeper.doc_id) for r in state.collect()) == [(3, 6), (3, 7), (3, 8)]


def test_exact_fetches_hits_by_locator(spark, docs_of, tmp_path):
    docs_of([(i, f"Text {i}") for i in range(500)]).repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    hits = docs.where("doc_id % 9 = 0").select(exact_dedup.locator().alias("at"))
    rows = exact_dedup.fetched(docs, hits, "text")
    assert sorted(r.body for r in rows.collect()) == sorted(f"text {i}" for i in range(0, 500, 9))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert exact_dedup.fetched(docs, hits.limit(0), "text").count() == 0


def test_exact_raises_where_digests_collide(docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 1)))
    with pytest.raises(RuntimeError, match="share the SHA-256 digest"):
        exact_dedup.exact_dedup(docs_of([(i, f"t{i}") for i in range(40)])).collect()


def test_substring(odd, none):
    rows = substring_dedup.substring_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    n = len(LONG.split())
    assert (by[5].n_words, by[5].n_removed) == (n, 0) and (by[6].n_removed, by[6].kept) == (n, b"tail")
    assert by[6].removed == [[0, n]] and by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[None].n_removed == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_intervals(docs_of):
    w = [f"a{i}" for i in range(100)]
    df = docs_of([(1, " ".join(w)), (2, " ".join(w[:20] + ["x"] + w[40:60] + ["y"] + w[10:22])), (3, " ".join(w[:12])), (4, "x " * 40)])
    by = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    assert by[2].removed == [[0, 20], [21, 41]] and by[3].n_removed == 0 and by[4].n_removed == 0


def test_substring_chunks_and_homes_change_nothing(spark, docs_of):
    """Small chunks, repeated identifiers and negative ones against a plain count."""
    rng = random.Random(9)
    passages = [[f"p{i}-{j}" for j in range(30)] for i in range(8)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.7 else [f"u{rng.random()}" for _ in range(20)]
        rows.append((rng.choice([i - 40, i - 40, 3, None]), " ".join(words)))
    starts = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            if d is not None:
                starts[tuple(w[i : i + 13])] = min(d, starts.get(tuple(w[i : i + 13]), d))
    want = []
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if d is not None and starts[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((str(d), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    for most in (1, 40, 10**6):
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept.decode()) for r in substring_dedup.substring_dedup(docs_of(rows), chunk_windows=most).collect()]
        assert sorted(got) == sorted(want)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_patterns_that_fool_polynomial_hashes(docs_of):
    """A Thue-Morse word and its complement, equal under any polynomial modulo 2**64, are told apart."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(12))
    df = docs_of([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, a), (4, b)])
    assert [r.n_removed for r in substring_dedup.substring_dedup(df).collect()] == [0] * 4
    assert all(r.kept for r in near_dedup.near_dedup(df).where("doc_id > 2").collect())


def test_near(odd, none):
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 4, 8: 8}
    assert all(r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_dedup(none).count() == 0
    assert near_dedup.drop_near(odd).columns == odd.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equals_all_pairs(docs_of, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"{g}-{rng.randint(0, 400)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([1, 5, 40])):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                text[rng.randrange(len(text))] = f"e{rng.random()}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(1000, rows[0].upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(rows)).collect()}
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("edits", [1, 5, 9])
def test_near_blocks_of_a_large_group(docs_of, monkeypatch, edits):
    """A large group meets its core, then what is left in pairs of blocks; small blocks change nothing."""
    rng = random.Random(edits)
    rows = []
    for g in range(2):
        base = [f"w{g}-{i}" for i in range(200)]
        for i in range(50):
            text = list(base)
            for _ in range(rng.randint(1, edits)):
                text[rng.randrange(200)] = f"e{g}-{i}-{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CENTRES", 3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(rows)).collect()}
    assert got == brute_components(rows, 4)


def test_core_of_a_group():
    links = np.eye(5, dtype=bool)
    for i, j in ((0, 1), (2, 3), (3, 4)):
        links[i, j] = links[j, i] = True
    assert near_dedup._core(links) == [-1, -1, 2, 2, 3]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for j in (0.6, 0.8, 0.95):
        found = []
        for _ in range(30):
            n = 1000
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
            x, y = (near_dedup.odd_sketch(near_dedup.minhash(s)) for s in (a, b))
            found.append(near_dedup.estimate(np.bitwise_count(x ^ y).sum()))
        assert abs(np.mean(found) - j) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2400)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(16)).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_mixing(spark, docs_of, none):
    rows = [(i, "t", "en", f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(700)] + [(None, None, None, None), (5, "t", "en", "s1")]
    df = docs_of(rows)
    placed = mixing.mix(df, block_rows=4, period=50).collect()
    assert len(placed) == len(rows) and len({r.position for r in placed}) == len(rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert mixing.mixed(none).count() == 0
    given = mixing.mix(df, {"s1": 3.0, None: 1.0, "absent": 9.0}, block_rows=2, period=40).collect()
    assert len(given) == len(rows)


@pytest.mark.parametrize("seed", range(5))
def test_pfair_bound(seed):
    rng = random.Random(seed)
    for _ in range(40):
        blocks = {f"s{i}": rng.randint(1, 80) for i in range(rng.randint(1, 8))}
        weights = {k: rng.random() + 0.01 for k in blocks}
        done = dict.fromkeys(blocks, 0)
        for p in mixing.phases(blocks, weights, 50):
            order = {}
            for k, at in p["at"].items():
                for j in range(p["took"][k]):
                    order[j // len(at) * p["period"] + at[j % len(at)]] = k
            assert sorted(order) == list(range(len(order)))
            seen = dict.fromkeys(p["at"], 0)
            for t in range(len(order)):
                seen[order[t]] += 1
                assert all(abs(seen[k] - (t + 1) * len(p["at"][k]) / p["period"]) < 1 for k in seen)
            for k in p["at"]:
                assert p["first"][k] == done[k]
                done[k] += p["took"][k]
        assert done == blocks


def test_html(spark):
    pg = (
        "<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>ok</div><div id=wrap><div class=content><h2>Head {n}</h2>"
        "<p>Text &lt;{n}&gt; on<b>e</b><br>two<ul><li>a<li>b {n}</ul><aside>side</aside></div><div class=sidebar>links</div>"
        "<section class='reader-comments'><p>nice {n}</p></section></div><form>f<input></form><script>x</script><footer>c</footer>"
    )
    rows = [(i, f"http://h.example/{i}", pg.replace("{n}", str(i))) for i in range(6)]
    rows += [(10, None, None), (11, "no url", ""), (12, "http://h.example/x", "<article>x<p>y"), (13, "http://o.example", "plain"), (0, "http://h.example/0", pg), (None, None, "<p>n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("content", F.lit(2))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=str)
    by = {(i, t) for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    for i in range(6):
        assert (i, f"Head {i} Text <{i}> one two a b {i}") in by
    assert {(10, ""), (11, ""), (12, "x y"), (13, "plain"), (None, "n")} <= by
    assert html_extract.extract(df.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[50:90] = base[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(400, None), (420, [1.0] * 7 + [None]), (440, [math.nan] * 8), (460, [math.inf] + [0.0] * 7), (461, []), (480, [1.0] * 3), (None, [1.0] * 8), (60, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("score", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    clean = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64))) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all()]
    want = []
    for q in range(0, 300, 20):
        x = min((v for i, v in clean if i == q), key=lambda v: v.astype(np.int16).tobytes())
        best = sorted(((-int(x @ v), i) for i, v in clean if i != q))[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id in (20, 3)")).collect()[0].vec_id == 3


def test_topk_visits_few_annuli_of_clustered_vectors():
    """The share of rows that the bounds leave to a query, given its exact 20th score."""
    rng = np.random.default_rng(1)
    x = np.floor(64 * np.concatenate([c + rng.normal(0, 0.05, (100, 16)) for c in rng.normal(0, 1, (60, 16))]))
    most = float((x * x).sum(axis=1).max())
    long = topk._longer(x, most)
    centre, edges = topk.fit_pivots(long[::2], topk.PIVOTS, topk.RINGS)
    annulus, d = topk.assign(long, centre, edges)
    held = topk.spans(annulus, d)
    assert sum(n for n, _, _ in held.values()) == len(x)
    size, low, high = (np.array(v) for v in zip(*held.values()))
    q = x[::20]
    scores = np.sort(q @ x.T, axis=1)[:, -21]
    may = topk.reach(q, centre, low, high, most)
    for a, n in zip(held, range(len(held))):  # the bound holds for every row of an annulus
        assert ((q @ x[annulus == a].T).max(axis=1) <= may[:, n] + 1e-6 * np.abs(may[:, n])).all()
    visited = ((may >= scores[:, None]) * size).sum() / (len(q) * len(x))
    assert visited < 0.3


def test_topk_in_several_rounds_and_lengths(spark, monkeypatch):
    """Small units and rounds change nothing; lengths keep apart."""
    monkeypatch.setattr(topk, "UNIT", 16)
    monkeypatch.setattr(topk, "GROWTH", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=5 if i % 3 else 7) * (600 if i % 50 == 0 else 1)]) for i in range(400)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=5).collect())
    want = []
    for q, v in rows:
        if q % 20 == 0:
            x = np.floor(64 * np.array(v))
            best = sorted((-int(x @ np.floor(64 * np.array(w))), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want


def test_pii_deobfuscation():
    def extra(text):
        base = pii.find(text)
        return [(k, text[s:e]) for k, s, e in pii.added(text, base)]

    assert extra("mail john dot doe at example dot com now") == [("email", "john dot doe at example dot com")]
    assert extra("john [at] mail [dot] example [dot] org") == [("email", "john [at] mail [dot] example [dot] org")]
    assert extra("jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert extra("call plus one two three four five five five one two one two") == [("phone", "plus one two three four five five five one two one two")]
    assert extra("192[.]168[.]1[.]10") == [("ip", "192[.]168[.]1[.]10")]
    assert extra("4１11 1111 1111 1111") == [("card", "4１11 1111 1111 1111")]
    assert extra("jo​hn@ex​ample.com") == [("email", "jo​hn@ex​ample.com")]
    for clean in ("meet me at noon", "look at example.com now", "one two three go", "dot dot dot", "a@b.com", "", "un deux trois"):
        assert extra(clean) == []
    assert pii.redact("write to a@b.com or 1.2.3.4") == "write to [email] or [ip]"


def test_pii_rows(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    assert pii.personal_data(none).count() == 0


def test_sentencepiece(odd, none):
    rows = sentencepiece_codec.encode(odd, parity=True).collect()
    assert len(rows) == len(ODD) and all(r.round_trip and r.parity for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 0
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).collect()}
    assert back[5] == LONG and back[1] == "" and back[8] == ODD[-1][1]
    assert sentencepiece_codec.encode(none).count() == 0


STRANGE = ["", " ", "  a  b ", " x", "x ", "\n\n a\tb\x00c", "<s> hi </s> <unk>", "▁▁a ▁", "日本語🙂 é", "a" * 3000, "  " * 50, "<0x41>", " x\xa0y"]


def test_sentencepiece_parity_on_strange_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    coder = sentencepiece_codec.WordCoder(sentencepiece_codec.MODEL, sp)
    ids, n, back, same = coder.code(STRANGE)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(STRANGE)
    assert all(same) and [t for t, ok in zip(STRANGE, back) if not ok] == ["▁▁a ▁"]


def _field(number, kind, payload):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    body = varint(payload) if kind == 0 else payload if kind == 5 else varint(len(payload)) + payload
    return varint(number << 3 | kind) + body


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_by_hand(tmp_path, squeeze):
    """A unigram model written field by field: scores, byte fallback and space rules against the library."""
    import struct

    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("c", -3.3, 1), ("▁a", -3.5, 1), ("ab", -4.0, 1), ("▁ab", -4.1, 1), ("bc", -4.2, 1), ("abc", -6.0, 1), ("▁b", -4.4, 1)]
    data = b"".join(_field(1, 2, _field(1, 2, t.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for t, s, k in pieces)
    data += _field(2, 2, _field(3, 0, 1) + _field(35, 0, 1) + _field(4, 0, len(pieces)))
    data += _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, squeeze) + _field(5, 0, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    tok = sentencepiece_codec.load(str(path))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabbc  é") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    if squeeze:
        texts = [t for t in texts if t.strip()]
    assert [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)] == sp.encode(texts)


def test_quality_and_language(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (9, 5, 0), (10**6, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "score")
    more = spark.createDataFrame([(i + 100, "good plain words here " * 5 if i % 2 else "### %%% !!! @@@ " * 5, ("en", "fr", None)[i % 3], None, 1, "x") for i in range(200)], docs.schema)
    table = docs.unionByName(more)
    rows = quality.op8_query(table, labels).collect()
    assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(table, labels).columns == table.columns
    assert quality.op8_query(none, labels).count() == 0
    assert {r.score for r in quality.op8_query(docs, labels.limit(0)).collect()} == {0.5}
    langs = {r.doc_id: (r.lang_pred, r.score) for r in langid.op9_query(table).collect()}
    assert langs[1] == langs[2] == langs[3] == ("und", 0.0) and all(v[0] in ("en", "fr", "und") for v in langs.values())
    assert langid.op9_query(none).count() == 0
    assert {r.lang_pred for r in langid.op9_query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_families():
    assert [langid.family(x) for x in ("en", "de-AT", "fr", "ES", "zz")] == ["germanic", "germanic", "romance", "romance", "zz"]
    families, heads = langid.plan(["en", "de", "fr", "es"])
    assert families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert heads == [("family", "germanic", ""), ("family", "romance", ""), ("pair", "de", "en"), ("pair", "es", "fr")]


def test_seventy_languages_are_learned(spark):
    """Every value of lang can be predicted, however many there are and whatever it is called."""
    rng = random.Random(3)
    langs = [f"x{i}" for i in range(58)] + ["en", "de", "nl", "fr", "es", "it", "ru", "pl", "cs", "fi", "hu", "tr"]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(40)] for x in langs}
    rows = [(70 * n + i, " ".join(rng.choices(words[x], k=30)), x, "s", 1) for n in range(14) for i, x in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in langid.op9_query(docs).collect()}
    held = [(x, got[i].lang_pred) for i, _, x, *_ in rows if got[i].held_out]
    assert {p for _, p in held} == set(langs) and sum(x == p for x, p in held) >= 0.95 * len(held)


def test_numerals_are_no_letters(spark, docs_of):
    import unicodedata

    every = [chr(c) for c in range(0x110000)]
    assert all(bool(langid.words_of(c)) == unicodedata.category(c).startswith("L") for c in every)
    texts = [(i, t) for i, t in enumerate(["½", "②", "Ⅷ 12", "3 ¾"])] + [(10 + i, f"the words of text number {i}") for i in range(30)]
    rows = {r.doc_id: r.lang_pred for r in langid.op9_query(docs_of(texts)).collect()}
    assert [rows[i] for i in range(4)] == ["und"] * 4 and rows[10] == "en"
