"""The pipeline's stages on whole tables, each against what its decisions must be."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footage_lake.llm import common, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs = first
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(first.columns), name
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before and out.count() == len(after)
        docs = out
    assert simhash.near_copies(docs).where("NOT kept OR n > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 0


CLASHING = ["sig", "place", "kept", "n", "near_id", "label_id", "spans", "score", "root", "h"]


def test_stages_on_odd_rows(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    good = first.where("n_chars > 500").orderBy("doc_id").limit(3)
    rows = [(None, "words " * 30), (3, None), (3, None), (4, ""), (5, " \t\n"), (8, "token = abcdef123 " * 30)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], first.select("doc_id", "text", "lang", "source", "n_chars").schema)
    every = odd.unionByName(good).unionByName(good).select(*first.columns)
    wide = every
    for c in CLASHING:
        wide = wide.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        assert out.count() <= wide.count()
        assert stage(spark, wide.where("false"), SF).count() == 0, name
    once = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, every, SF)
    assert once.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").count() == 0
    kept = dict(corpus_pipeline.STAGES)["quality rules"](spark, every, SF)
    assert kept.where("text IS NULL OR length(trim(text)) = 0").count() == 0
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, wide, SF)
    assert packed.where("start = 0").count() == wide.count()


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())
