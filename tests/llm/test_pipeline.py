"""The pipeline's stages on a small corpus, each against what brute force says of its own input."""

from collections import Counter

import corpus_pipeline
from marginalia.llm import pii

from .helpers import SCHEMA, components, empty_docs, fingerprint, odd_docs, odd_rows, prose


def _tables(spark, folder):
    rows = [r for r in odd_rows()]
    rows += [(100 + i, prose(60, 6000 + i) + (" vile rotten" if i % 4 == 0 else ""), "en", "s2", 1) for i in range(160)]
    item = prose(35, 77)
    rows += [(900, prose(40, 7000) + " " + item + " " + prose(30, 7001), "en", "s3", 1), (901, "write to q.x1@ex.org " + prose(60, 7002), "en", "s3", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage(spark, tmp_path):
    sf = str(tmp_path / "sf")
    _tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == columns
        after = [tuple(r) for r in docs.collect()]
        kept.append((name, before, after))
    (_, b0, a0), (_, b1, a1), (_, b2, a2), (_, b3, a3), (_, b4, a4) = kept
    assert not Counter(a0) - Counter(b0) and len(a0) < len(b0)
    assert {r[0] for r in b0} - {r[0] for r in a0} <= {100 + i for i in range(0, 160, 4)}
    comp = components([fingerprint(r[1]) for r in b1])
    assert len(a1) == len(set(comp)) and not Counter(a1) - Counter(b1)
    low = {}
    for r, c in zip(b1, comp, strict=True):
        low[c] = min((x for x in (low.get(c), r[0]) if x is not None), default=None)
    assert Counter(r[0] for r in a1) == Counter(low.values())
    assert 900 in {r[0] for r in b2} and {r[0] for r in b2} - {r[0] for r in a2} == {900}
    assert Counter((r[0], pii.reveal(r[1], pii.EXAMPLE_KEY) if r[1] else r[1]) for r in a3) == Counter(r[:2] for r in b3)
    assert all("q.x1@" not in (r[1] or "") for r in a3)
    assert {r[0] for r in a4} == {r[0] for r in b4}
    assert corpus_pipeline.run(spark, sf).count() == len(a4)


def test_stages_on_odd_rows_with_clashing_columns(spark, tmp_path):
    """Null, repeated and shared doc_ids, null texts, and columns of the names that the stages use inside."""
    sf = str(tmp_path / "sf")
    _tables(spark, sf)
    docs = odd_docs(spark)
    more = [(None, prose(90, 60 + i), "en", "s", 1) for i in range(4)] + [(20, prose(90, 80), "en", "s", 1), (20, prose(90, 81), "en", "s", 1)] + [(21, prose(90, 82), "en", "s", 1)] * 3
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA).selectExpr("*", *[f"'own' as `{c}`" for c in docs.columns[5:]]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        rows = [tuple(r) for r in after.collect()]
        if name == "simhash":
            comp = components([fingerprint(r[1]) for r in before])
            assert len(rows) == len(set(comp)) and not Counter(rows) - Counter(before)
        else:
            assert len(rows) == len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert Counter(r[0] for r in pieces.where("piece = 0").select("doc_id").collect()) == Counter(r[0] for r in before)


def test_stages_on_an_empty_table(spark, tmp_path):
    sf = str(tmp_path / "sf")
    _tables(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), sf).count() == 0
