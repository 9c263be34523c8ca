"""Live regions and peaks of a stream equal the batch result over the same rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from footage_lake.operators import cuts
from footage_lake.streaming.peaks import live_peaks
from footage_lake.streaming.regions import live_regions


def test_live_regions(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("p", "a", at(k * 100), 0.4 if 5 <= k <= 9 or 20 <= k <= 22 else 0.01) for k in range(40)] + [("p", "a", at(600_000), 0.4)]
    frame = spark.createDataFrame(rows, "project_id string, asset_id string, at timestamp, cut_score double")
    frame.write.parquet(str(tmp_path / "in"))
    want = sorted((r["start"], r["n_points"]) for r in live_regions(frame, 0.1).collect())
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = live_regions(stream, 0.1).writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["start"], r["n_points"]) for r in spark.table("live").collect())
    assert len(want) == 3 and got == want[:2]  # the last session is still open


def test_live_peaks_equal_the_batch(spark, tmp_path):
    """Points come out of order over several batches; what the watermark has passed equals the batch result."""
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    points = [("p", a, k * 40_000 + rng.randint(0, 20_000), rng.choice([0.1, 0.1, 0.2, rng.random()])) for a in "abc" for k in range(150)]
    points += [("p", "lone", 900_000, 0.9), ("p", "d", 100_000, None)]
    rows = [(p, a, start + dt.timedelta(microseconds=t), c) for p, a, t, c in points]
    kind = "project_id string, asset_id string, at timestamp, cut_score double"
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(milliseconds=rng.randint(0, 700)))
    order[5:5] = [("p", "d", None, 0.5)]
    source = tmp_path / "in"
    source.mkdir()
    base = int(start.timestamp() * 1_000_000)
    scores = spark.createDataFrame([(p, a, t + base, c) for p, a, t, c in points if c is not None], "project_id string, asset_id string, t_us bigint, cut_score double")
    batch = cuts.prominence(cuts.local_maxima(scores)).where("is_max AND prominence >= 0.25").collect()
    want = {(r["asset_id"], r["t_us"]): r["prominence"] for r in batch}
    stream = live_peaks(spark.readStream.schema(kind).parquet(str(source)), late="1 second")
    groups = [order[k : k + 60] for k in range(0, len(order), 60)]
    far = start + dt.timedelta(hours=1)
    q = stream.writeStream.outputMode("append").format("memory").queryName("peaks").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows_of in enumerate([*groups, [("p", "end", far, 0.0)]]):
            spark.createDataFrame(rows_of, kind).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
            if k == len(groups) - 1:
                before = spark.table("peaks").count()
    finally:
        q.stop()
    got = {(r["asset_id"], r["t_us"]): r["prominence"] for r in spark.table("peaks").collect()}
    assert spark.table("peaks").count() == len(got) and 0 < before < len(got)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_state_of_a_long_asset_is_many_rows(spark, tmp_path):
    """Points of one asset, uneven and next to borders of slots, are held slot by slot and judged as the batch does."""
    rng = random.Random(3)
    times = sorted({rng.randint(0, 120_000_000) for _ in range(1500)} | {k * 1_000_000 + d for k in range(0, 120, 7) for d in (-1, 0, 1, 100_000, 500_000, 500_001) if k or d >= 0})
    scores = spark.createDataFrame([("p", "a", t, rng.choice([0.1, 0.1, 0.2, rng.random()])) for t in times], "project_id string, asset_id string, t_us bigint, cut_score double")
    batch = cuts.prominence(cuts.local_maxima(scores)).where("is_max AND prominence >= 0.25").collect()
    want = {r["t_us"]: r["prominence"] for r in batch}
    rows = scores.select("project_id", "asset_id", F.timestamp_micros("t_us").alias("at"), "cut_score")
    end = spark.createDataFrame([("p", "end", dt.datetime(1970, 1, 2, tzinfo=dt.UTC), 0.0)], rows.schema)
    rows.unionByName(end).write.parquet(str(tmp_path / "in"))
    q = live_peaks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("long").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    finally:
        q.stop()
    got = {r["t_us"]: r["prominence"] for r in spark.table("long").collect()}
    assert held >= 60
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[t] - want[t]) < 1e-9 for t in want)
