"""The registered queries against their SQL, their contracts and brute force, on whole tables."""

import hashlib
import re

import pytest
from query_compare import same

from causeway.llm import catalog, pii


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert same(catalog.queries()[name](spark, sf), duck.sql(catalog.oracle_sql()[name]))


def test_each_operator_has_one_query():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_op2_keeps_all_rows_within_a_block(spark, sf):
    from causeway.llm.mixing import units

    rows = catalog.queries()["op2_mix_sources"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len({r.position for r in rows}) == len(rows)
    sizes = {}
    for r in docs.select("source").collect():
        sizes[r.source] = sizes.get(r.source, 0) + 1
    share = units({k: n**0.7 for k, n in sizes.items()}, 1000)
    first = sorted({(r.slot, r.source) for r in rows if r.phase == 0})
    seen = dict.fromkeys(sizes, 0)
    for t, (slot, source) in enumerate(first, 1):
        assert slot == t - 1
        seen[source] += 1
        assert all(abs(seen[k] - t * share[k] / 1000) < 1 for k in sizes)


def test_op6_base_spans(spark, sf):
    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.queries()["op6_personal_data"](spark, sf).collect():
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))


def test_op7_round_trip_and_whole_text_parity(spark, sf):
    import sentencepiece

    from causeway.llm.sentencepiece_codec import MODEL

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.queries()["op7_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip and r.parity


def test_op8_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = catalog.queries()["op8_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.9 * len(bad)


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = catalog.queries()["op9_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_op10_equals_all_pairs(spark, sf):
    from llm_helpers import brute_components

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(texts, 4)
    rows = catalog.queries()["op10_minhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)
