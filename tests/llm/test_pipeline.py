"""The pipeline: each stage on what its predecessor kept, against the operators and brute force."""

import pandas as pd
from test_corpus import classes
from test_scans import base, contaminated

import corpus_pipeline
from evigrid.llm import common, pii, registry


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), "stage")
        kept.append(docs.toPandas())
        if name != "best-fit packing":
            assert docs.columns == columns
    quality, unique, clean, masked, packed = kept
    labels = pd.read_parquet(f"{small}/labels.parquet")
    failed = {r.doc_id for r in before.itertuples() if base(r.text)[-1]}
    good = set(labels.doc_id[labels.quality == 1]) - failed
    assert not failed & set(quality.doc_id) and len(good - set(quality.doc_id)) <= 0.02 * len(good)
    pairs = [(int(r.doc_id), r.text) for r in quality.itertuples()]
    assert set(unique.doc_id) == {c for _, c, *_ in classes(pairs)} and unique.doc_id.is_unique
    items = list(pd.read_parquet(f"{small}/benchmark.parquet").itertuples(index=False))
    dirty = {doc for doc, *_, bad in contaminated([(r.doc_id, r.text) for r in unique.itertuples()], items) if bad}
    assert set(clean.doc_id) == set(unique.doc_id) - dirty and dirty
    assert set(masked.doc_id) == set(clean.doc_id) and not any(pii.detect(t) for t in masked.text) and (masked.n_chars == masked.text.str.len()).all()
    assert set(packed.doc_id) == set(masked.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, small).count() == len(packed)


def test_stages_on_odd_rows(spark, docs, none, tmp_path):
    """Nulls, repeated rows, very long texts, clashing columns and empty tables: all stages run, and none invents rows."""
    digits = spark.createDataFrame([(77_777, "0" * 5000 + "1.1.1.1 " + " ".join(f"word{i}" for i in range(60)))], "doc_id long, text string")
    docs = docs.unionByName(digits, allowMissingColumns=True)
    for name, filled in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], filled).write.parquet(f"{tmp_path}/{name}.parquet")
    for table in (docs, none):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        have = {r.doc_id for r in table.select("doc_id").distinct().collect()}
        left = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            left = common.stored(stage(spark, left, str(tmp_path)), "odd")
            assert {r.doc_id for r in left.select("doc_id").collect()} <= have
            if name != "best-fit packing":
                assert left.columns == table.columns
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == left.count()
    assert left.count() == 0


def test_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14) if f"op{i}" in {x.split("_")[0] for x in names}]
    assert set(registry.oracle_sql()) <= set(names)
