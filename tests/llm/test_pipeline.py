"""The corpus pipeline stage by stage, each held against a plain restatement of it."""

import re

from llm_helpers import brute_components, lower

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "SentencePiece encoding"]
    steps = [f for _, f in corpus_pipeline.STAGES]
    from causeway.llm.common import cut

    good = cut(steps[0](spark, docs, sf), "t")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    assert good.columns == columns and left <= set(rows)
    assert sum(i in left for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())

    one = cut(steps[1](spark, good, sf), "t")
    by = {}
    for i in left:
        by.setdefault(lower(rows[i]), []).append(i)
    kept = {max(v) for v in by.values()}
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(kept)

    near = cut(steps[2](spark, one, sf), "t")
    want = brute_components([(i, rows[i]) for i in kept], 5)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(set(want.values()))

    mixed = cut(steps[3](spark, near, sf), "t")
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(set(want.values()))

    coded = steps[4](spark, mixed, sf).collect()
    from causeway.llm import mixing

    order = [r.row.doc_id for r in mixing.mix(near).orderBy("position").collect()]
    assert [r.doc_id for r in sorted(coded, key=lambda r: (r.mix_part, r.mix_row))] == order
    assert sorted(r.doc_id for r in coded) == sorted(set(want.values())) and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)


def test_stages_on_odd_tables(spark, docs_of, tmp_path):
    """Empty tables, nulls in every column, repeated rows and columns of clashing names."""
    spark.createDataFrame([(1, 1, 0), (None, 0, None), (3, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None), (2, ""), (None, None, None, None), (None, "a b"), (4, "some words here"), (4, "some words here"), (5, "Some words here"), (None, "a b")]
    for df in (docs_of([]), docs_of(rows)):
        docs = df
        for n, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, docs, str(tmp_path))
            if n < 4:
                assert out.columns == df.columns
                path = f"{tmp_path}/{n}-{df.count()}"
                out.write.parquet(path)
                docs = spark.read.parquet(path)
        got = out.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
        assert {4, 5} & {r.doc_id for r in got} == ({5} if rows and got else set())


def test_run_registered(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None and re.match("run", corpus_pipeline.run.__name__)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
