"""Packing along a curve, vector codes and whitening against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causeway.llm import catalog, packing, vector_codes, whitening

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


# --- packing -----------------------------------------------------------------


def check_pieces(pieces, texts, whole, length=packing.LENGTH):
    """Every id in exactly one piece, sequences without gaps, nothing to pad; ``texts`` are (doc_id, text) rows."""
    want = sorted((str(i), n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, whole(t) + [packing.END]) for i, t in texts) for n in [len(ids)])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    found = []
    for i, own in by_doc.items():
        n = sum(str(i) == str(d) for d, _ in texts)
        assert sum(p.length for p in own) == sum(len(whole(t)) + 1 for d, t in texts if d == i)
        if n == 1:
            own.sort(key=lambda p: p.start)
            assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]
            found.append((str(i), own[0].doc_tokens, zlib.crc32(b"".join(p.ids for p in own))))
    assert sorted(found) == [w for w in want if sum(str(d) == w[0] for d, _ in texts) == 1]
    sizes = {}
    for s, own in by_sequence.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]
        sizes[s] = sum(p.length for p in own)
    assert all(n == length or (n < length and n & (n - 1) == 0) for n in sizes.values())
    assert sum(n < length for n in sizes.values()) <= length.bit_length() and sorted(sizes) == list(range(len(sizes)))


def test_op11_against_whole_texts(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], whole)
    rows = catalog.queries()["op11_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows) == sorted(
        (p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, p.sequence_id, p.offset) for p in pieces
    )


def test_packing_odd_rows(docs_of, whole):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One, two."), (5, long), (None, "no id"), (None, "no id at all"), (7, "é ü ünï"), (9, "x" * 30_000)]
    docs = docs_of(rows + [(4, "One, two.")] * 3)
    check_pieces(packing.pack(docs, PATH).collect(), rows + [(4, "One, two.")] * 3, whole)
    check_pieces(packing.pack(docs, PATH, length=8).collect(), rows + [(4, "One, two.")] * 3, whole, 8)
    assert packing.pack(docs_of([]), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, length=100)


def test_packed_sequences_are_whole(docs_of, whole):
    texts = [(i, f"number {i} " * (i % 40)) for i in range(60)]
    rows = packing.sequences(packing.pack(docs_of(texts), PATH, length=64)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(whole(t)) + 1 for _, t in texts) and all(len(r.ids) == r.n_tokens for r in rows)
    assert sum(list(r.ids).count(packing.END) for r in rows) >= 60


def test_words_are_coded_as_whole_texts(whole):
    coder = packing.WordIds(PATH, limit=50)
    rng = random.Random(4)
    signs = ["a", "B", "É", "ß", "İ", "Σ", "'s", "'LL", ".", ",", "...", "!?", "1", "½", "²", "́", " ", " ", "\x1c", "\x85", "‍", "😀", "漢字", " ", "\n", "\t", "\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(600)]
    for at in range(0, 600, 60):
        ids, n = coder.code(pa.array(texts[at : at + 60]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in texts[at : at + 60]]


def test_latin_words_pass_by_the_rules(whole):
    """Words of Latin letters, with any run of marks behind, cost the merges alone."""
    coder = packing.WordIds(PATH)
    assert coder.tok.to_str() != coder.merges.to_str()
    told = []

    class Watched:
        def encode_batch_fast(self, texts, **kw):
            told.extend(w for t in texts for w in t.split())
            return tok.encode_batch_fast(texts, **kw)

        def encode_batch(self, parts, **kw):
            told.extend(w for p in parts for w in p)
            return tok.encode_batch(parts, **kw)

    tok, coder.tok = coder.tok, Watched()
    texts = ["Été à Österreich!!! Straße... éçané###\nword.*** ÀÉÎ& plain", "don't l'été ... x² a1 Σας", "", "ÿes.'s no.]~"]
    ids, n = coder.code(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole(t) for t in texts]
    assert not {w for w in told if w.isalpha()} - {"Σας"}
    assert {"!!!", "...", "###", ".***", "&"} <= set(told)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_places_are_a_walk(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = packing.hilbert(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbour


def test_neighbours_share_sequences(docs_of):
    """Texts of a topic lie closer together in the stream than texts of any."""
    rng = random.Random(2)
    words = {t: [f"{t}{rng.choice('bcdfgh')}{rng.choice('aeiou')}{i}" for i in range(30)] for t in ("alpha", "bravo", "delta", "gamma")}
    texts = [(i, " ".join(rng.choices(words[list(words)[i % 4]], k=60))) for i in range(200)]
    pieces = packing.pack(docs_of(texts), PATH, length=1024).collect()
    topics = {}
    for p in pieces:
        topics.setdefault(p.sequence_id, []).append((p.length, p.doc_id % 4))
    same = sum(max(sum(n for n, t in own if t == k) for k in range(4)) for own in topics.values())
    assert same / sum(p.length for p in pieces) > 0.6  # about 0.3 if dealt at random


# --- vector codes --------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale=256):
    """(vec_id, code, error) rows and the codebook of vectors of one length; ``rows`` are (vec_id, vector)."""
    x = sorted(((i is None, i or 0, vector_codes._pack(np.floor(scale * np.array(v, float)))) for i, v in rows))
    x = [(None if none else i, [int(c) for c in vector_codes._matrix([b], len(rows[0][1]))[0]]) for none, i, b in x]
    d = len(rows[0][1])
    at = [p * d // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, v in x[:entries]] for a, b in zip(at, at[1:])]

    def near(v, book):
        return min((sum((p - q) ** 2 for p, q in zip(v, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(at, at[1:])):
            got = {}
            for _, v in x:
                got.setdefault(near(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(got[n]) for c in zip(*got[n])] if n in got else e for n, e in enumerate(books[p])]
    out = []
    for i, v in x:
        each = [near(v[a:b], books[p]) for p, (a, b) in enumerate(zip(at, at[1:]))]
        out.append((i, "".join(f"{n:02x}" for _, n in each), sum(s for s, _ in each)))
    return out, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def key(rows):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    # few distinct values, so that ties abound
    base = rng.integers(-3, 4, size=(160, 8)) / 256 if seed else rng.normal(size=(160, 8))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [rows[3], rows[4], (None, rows[5][1]), (7, [0.5] * 8), (7, [-0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("code", F.lit(1)).withColumn("n", F.lit(1))
    found, books = vector_codes.compress(df.repartition(5), parts=4, entries=16, rounds=3)
    want, digest = brute_codes(rows, 4, 16, 3)
    assert key((r.vec_id, r.code, r.error) for r in found.collect()) == key(want) and books[8].digest() == digest


def test_codes_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label string, _key int, dims string"
    rows = [(i, [float(i % 5), 1.0, -2.0, float(i)], None if i % 3 else "a", 1, "x") for i in range(12)]
    odd = [(90, None, "a", 1, "x"), (91, [1.0, None, 2.0, 3.0], "a", 1, "x"), (92, [math.nan] * 4, "a", 1, "x"), (93, [math.inf] * 4, "b", 1, "x"), (94, [], "b", 1, "x"), (95, [3.0] * 18, "b", 1, "x")]
    got = vector_codes.op12_query(spark.createDataFrame(rows + odd, schema)).collect()
    assert sorted(r.vec_id for r in got) == [*range(12), 94, 95]
    by = {r.vec_id: r for r in got}
    want, digest = brute_codes([(i, v) for i, v, *_ in rows], 16, 64, 2)
    assert [(i, by[i].code, by[i].error) for i in range(12)] == want and by[0].codebooks_sha256 == digest
    sums = {}
    for i, _, label, *_ in rows + odd[-2:]:
        sums[label] = sums.get(label, 0) + by[i].error
    assert all(by[i].label_error == sums[label] for i, _, label, *_ in rows + odd[-2:])
    assert by[95].error == 0 and by[94].code == "00" * 16
    none = spark.createDataFrame(rows, schema).limit(0)
    assert vector_codes.op12_query(none).collect() == [] and vector_codes.op12_query(none.drop("label")).collect() == []
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9])], "vec_id bigint, embedding array<double>"))


def test_hot_label_sums_whole(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") % (7 + i)).cast("float") / 9 for i in range(16)]).alias("embedding"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("label"))
    rows = vector_codes.op12_query(df).collect()
    hot = [r for r in rows if r.vec_id % 3]
    want = sum(r.error for r in hot)
    assert len(rows) == 300 and {r.label_error for r in hot} == {want}


def test_bounds_leave_most_distances_out():
    """On clusters, few distances are measured anew, and the result is that of measuring all."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([c + rng.normal(0, 0.02, (200, 8)) for c in rng.normal(0, 1, (32, 8))])).astype(np.int64)
    rng.shuffle(x)
    book = vector_codes.Codebook(x[:32].copy(), 2)
    code, upper, lower = book.first(x)
    for turn in range(3):
        moved = book.entries.copy()
        for p, (a, b) in enumerate(book.at):
            for e in np.unique(code[:, p]):
                moved[e, a:b] = x[code[:, p] == e, a:b].sum(axis=0) // (code[:, p] == e).sum()
        book = vector_codes.Codebook(moved, 2, book)
        measured = book.again(x, code, upper, lower)
        want, _, _ = vector_codes.Codebook(moved, 2).first(x)
        assert (code == want).all()
        for p, (a, b) in enumerate(book.at):
            d = np.sqrt(vector_codes.squared(x[:, a:b], moved[:, a:b]))
            assert (lower[:, p] * float(book.steps[p]) <= d + 1e-9).all() and (upper[:, p] >= d[np.arange(len(x)), code[:, p]] - 1e-9).all()
    assert measured < 0.3 * x.shape[0] * 2 * 32


def test_long_distances_are_exact():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-(1 << 27), 1 << 27, (5, 4)), rng.integers(-(1 << 27), 1 << 27, (3, 4))
    assert vector_codes.squared(x, c).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]


# --- whitening -----------------------------------------------------------------


def check_whitening(rows, got, components=4):
    """``rows`` are (vec_id, vector) of one length, all clean; ``got`` the result's rows."""
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.float64)
    n, total = len(fit), [int(t) for t in fit.sum(axis=0)]
    away = fit - fit.mean(axis=0)
    cov = away.T @ away / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    k = min(components, len(x[0]))
    assert len(got) == len(rows) * k and {r.component for r in got} == set(range(1, k + 1))
    dev = sorted((str(i), sum((n * a - t) ** 2 for a, t in zip(v, total))) for (i, _), v in zip(rows, x))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == dev and {r.n for r in got} == {n}
    for c, at in enumerate(order, 1):
        mine = [r for r in got if r.component == c]
        assert all(abs(r.explained - values[at] / np.trace(cov)) <= 1e-6 for r in mine) and all(r.identity_error <= 1e-4 for r in mine)
        if min(abs(values[at] - w) for j, w in enumerate(values) if j != at) > 1e-6 * values[at] > 1e-9:
            want = sorted((str(i), float((np.array(v) - np.array(total) / n) @ vectors[:, at] / np.sqrt(values[at]))) for (i, _), v in zip(rows, x))
            have = sorted((str(r.vec_id), r.whitened) for r in mine)
            big = max(range(len(want)), key=lambda j: abs(want[j][1]))
            sign = 1 if want[big][1] * have[big][1] > 0 else -1
            assert all(abs(a[1] - sign * b[1]) < 1e-6 for a, b in zip(want, have))


def test_op13_against_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(rows, catalog.queries()["op13_whitening"](spark, sf).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v * np.array([9, 5, 2, 1, 0.5])]) for i, v in enumerate(rng.normal(size=(80, 5)))]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0])]  # copies are fitted once
    odd = [(90, None), (91, [1.0, None, 2.0, 3.0, 1.0]), (92, [math.nan] * 5), (93, [-math.inf] * 5), (94, [])]
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame(rows + odd, schema).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    check_whitening(rows, whitening.whiten(df.repartition(7)).collect())
    assert whitening.whiten(df.limit(0)).collect() == []
    # fewer components than asked for, no variance, one row
    two = [(i, [float(i), 1.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(two, schema)).collect()
    assert len(got) == 18 and all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in got)
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 2
    # lengths keep apart
    both = whitening.whiten(spark.createDataFrame(two + rows, schema)).collect()
    check_whitening(rows, [r for r in both if r.n > 9])


def test_deviations_beyond_64_bits():
    w = whitening.Whitening(10, [10**18, 5], np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.ones(2, bool))
    assert w.deviations(np.array([[10**17, 3], [10**17 + 100, 0], [0, 0]])) == [25**2, 1000**2 + 25, None]


def test_merged_moments_are_those_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (1000, 6)) + 10**6
    parts = [whitening.Moments.of(p) for p in np.array_split(x, [1, 7, 500])]
    m = parts[2].merge(parts[0]).merge(parts[3].merge(parts[1]))
    away = x - x.mean(axis=0)
    assert m.n == 1000 and m.total.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(m.scatter, away.T @ away, rtol=1e-10) and np.allclose(m.mean, x.mean(axis=0), rtol=1e-14)
