"""The walk over close takes without their pairs, against the walk over the pairs."""

import pytest
from pyspark.sql import functions as F

from footage_lake.operators import dedup
from tests.test_close_pairs import clustered, close_hashes, takes

LINK = "struct<shot_id:string,relationship_type:string,coherence_score:double>"


def linked(frame):
    """Shots that share files, have links both ways and characters in opposite directions; some without a quality."""
    k = F.col("idx")
    to = lambda n, kind: F.struct(F.concat(F.lit("S"), n.cast("string")).alias("shot_id"), F.lit(kind).alias("relationship_type"), F.when(k % 2 == 0, 0.9).alias("coherence_score")).cast(LINK)
    return frame.withColumns(
        {
            "quality_score": F.when(k % 41 != 0, (k * 7 % 5).cast("double")), "source_file": F.when(k % 23 != 0, (k % 23).cast("string")), "source_path": F.lit(None).cast("string"),
            "characters": F.when(k % 6 == 0, F.lit(None)).otherwise(F.array(F.concat(F.lit("c"), (k % 4).cast("string")), F.concat(F.lit("c"), (k % 5).cast("string")), F.lit(None))),
            "direction": F.when(k % 3 == 0, "left to right").when(k % 3 == 1, "从右向左").otherwise(F.lit(None)), "prev": F.when(k % 7 == 0, to(k + 1, "情绪延续")), "next": F.when(k % 4 == 0, to(k + 4, "时间跳跃")),
        }
    )


def same(got, pairs):
    """The rows of both walks, which may not have a pair with a null quality decide in Python."""
    of = lambda rows: {(r["project_id"], r["beat"], r["shot_id"], r["kept_shot"]) for r in rows.collect()}
    found, n = of(got), got.count()
    assert found == of(dedup.resolve_greedy(pairs.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("q_a", "q_b")}))) and n == len(found)
    return n


@pytest.mark.parametrize("block, most, mode", [(10**6, 10, "bits"), (50, 10, "bits"), (7, 20, "bits"), (40, 3, "hex")])
def test_hashes(spark, block, most, mode):
    rows = [("p", "b" if k % 5 else "c", k, f"{h:016x}") for k, h in enumerate(close_hashes(300, 5))] + [("p", "b", 900, None), (None, "b", 901, "0" * 16)]
    shots = linked(takes(spark, rows, "phash string"))
    assert same(dedup.hash_losers(shots, most, mode, block), dedup.hash_pairs(shots, most, mode)) > 20


@pytest.mark.parametrize("block, least", [(10**6, 0.92), (60, 0.92), (25, 0.5)])
def test_vectors(spark, block, least):
    rows = [("p", "b" if k % 5 else "c", k, v.tolist()) for k, v in enumerate(clustered(300, 6, 10, 4))] + [("p", "b", 900, [1.0] * 3), ("p", "b", 901, [2.0] * 3), ("p", "b", 902, None), ("p", "b", 903, [])]
    shots = linked(takes(spark, rows, "vector array<double>"))
    assert same(dedup.vector_losers(shots, least, block), dedup.vector_pairs(shots, least)) > 20


def test_copies_are_walked_without_their_pairs(spark, monkeypatch):
    """30,000 copies have 450 million pairs."""
    rows = spark.range(30_000).select(F.lit("p").alias("project_id"), F.lit("b").alias("beat"), F.col("id").alias("idx"), F.lit("00ff" * 4).alias("phash"))
    shots = takes(spark, [], "phash string").unionByName(rows, allowMissingColumns=True).withColumns({"shot_id": F.concat(F.lit("S"), F.col("idx").cast("string")), "source_file": F.col("idx").cast("string"), "quality_score": F.lit(1.0), "status": F.lit(dedup.CANDIDATE), "dedup_reason": F.lit("")})
    monkeypatch.setattr(dedup, "hash_pairs", None)
    out = dedup.dedup_group(shots).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in out} == {dedup.CANDIDATE: 1, dedup.DISCARDED: 29_999}


@pytest.mark.parametrize("block, most", [(10**6, 10), (40, 10), (64, 20)])
def test_unrelated_pairs_as_numbers(spark, monkeypatch, block, most):
    """Told without a join of the pairs to their shots."""
    rows = [("p", "b" if k % 5 else "c", k, f"{h:016x}") for k, h in enumerate(close_hashes(300, 6))] + [("p", "b", 900, None)]
    shots = linked(takes(spark, rows, "phash string"))
    of = lambda pairs: sorted(map(tuple, pairs.select("project_id", "beat", "i", "j", "distance").collect()))
    want = of(dedup.hash_pairs(shots, most))
    monkeypatch.setattr(dedup.takes_walk.pairs, "__defaults__", (True, block))
    monkeypatch.setattr(dedup, "_told", None)
    assert of(dedup.hash_pairs(shots, most, shots=False)) == want and len(want) > 20
