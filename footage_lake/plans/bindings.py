"""The catalog's logical tables over the driver's tables, in Spark and as DuckDB text.

Assets are users of ``events`` with their values as frame scores; shots and decisions
are ``orders``; vectors are ``embeddings``; texts are ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footage_lake.functions.timecode import sec_to_tc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("project_id"),
        F.col("user_id").cast("string").alias("asset_id"),
        (F.lit(100_000).cast("bigint") * (F.row_number().over(w) - 1)).alias("t_us"),
        (F.col("value") / 500).alias("cut_score"),
    )


def assets(scores: DataFrame) -> DataFrame:
    return scores.groupBy("project_id", "asset_id").agg((F.max("t_us") + 100_000).alias("duration_us"))


FS = """fs AS (SELECT 'p' || CAST(user_id % 8 AS VARCHAR) AS project_id, CAST(user_id AS VARCHAR) AS asset_id,
  CAST(100000 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS BIGINT) AS t_us, value / 500 AS cut_score FROM events),
assets AS (SELECT project_id, asset_id, max(t_us) + 100000 AS duration_us FROM fs GROUP BY ALL)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    start, length = k % 3600, 5 + k % 20
    return read(spark, sf_dir, "orders").select(
        text("p", c % 16).alias("project_id"),
        text("S", k).alias("shot_id"),
        k.alias("idx"),
        F.when(F.col("o_orderstatus") == "O", "PROCESSED").when(F.col("o_orderstatus") == "F", "ANALYZED").otherwise("RAW").alias("state"),
        text("f", c).alias("source_file"),
        F.concat(F.lit("/m/f"), c.cast("string"), F.lit(".mov")).alias("source_path"),
        F.when(k % 11 == 0, "UNMATCHED").otherwise(F.concat("o_orderpriority", F.lit("-"), (c % 200).cast("string"))).alias("beat"),
        F.concat(F.lit("第"), (1 + k % 3).cast("string"), F.lit("幕")).alias("act"),
        sec_to_tc(start).alias("tc_in"),
        sec_to_tc(start + length).alias("tc_out"),
        length.cast("double").alias("duration_sec"),
        F.when(k % 3 == 0, 60.0).otherwise(24.0).alias("fps"),
        F.round(F.col("o_totalprice") / 50_000, 2).alias("quality_score"),
        (1 + k % 5).cast("double").alias("visual_quality"),
        (1 + c % 5).cast("double").alias("stability"),
        ((k % 10) / 10.0).cast("double").alias("confidence"),
        F.when(k % 2 == 0, "hello").otherwise("").alias("asr_text"),
        F.lit("").alias("dialogue"),
        F.array(text("c", c % 5), text("c", k % 4)).alias("characters"),
        F.when(k % 3 == 0, "left to right").when(k % 3 == 1, "right to left").otherwise("").alias("direction"),
        text("cam", k % 3).alias("camera_position"),
        F.when(k % 4 == 0, "未知").otherwise("pan").alias("camera_movement"),
        text("size", k % 2).alias("shot_size"),
        text("loc", c % 4).alias("location"),
        text("e", k % 2).alias("emotion"),
        F.when(k % 7 == 0, "").otherwise("walks").alias("action"),
        F.when(k % 9 == 0, F.array(F.lit("慢动作"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(k % 4 == 0, "50%").when(k % 4 == 1, "1x").when(k % 4 == 2, "200%").otherwise("2.5x").alias("speed"),
    )


TC = "lpad(CAST({s} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || ':00'"

# half up by the written digits, as Spark rounds; DuckDB's round of a double takes 1.005 down
ROUNDED = "CAST(round(CAST(CAST(o_totalprice / 50000 AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)"

SHOTS = f"""shots AS (SELECT 'p' || CAST(o_custkey % 16 AS VARCHAR) AS project_id, 'S' || CAST(o_orderkey AS VARCHAR) AS shot_id, o_orderkey AS idx,
  CASE o_orderstatus WHEN 'O' THEN 'PROCESSED' WHEN 'F' THEN 'ANALYZED' ELSE 'RAW' END AS state,
  'f' || CAST(o_custkey AS VARCHAR) AS source_file, '/m/f' || CAST(o_custkey AS VARCHAR) || '.mov' AS source_path,
  CASE WHEN o_orderkey % 11 = 0 THEN 'UNMATCHED' ELSE o_orderpriority || '-' || CAST(o_custkey % 200 AS VARCHAR) END AS beat,
  '第' || CAST(1 + o_orderkey % 3 AS VARCHAR) || '幕' AS act,
  {TC.format(s="(o_orderkey % 3600)")} AS tc_in, {TC.format(s="(o_orderkey % 3600 + 5 + o_orderkey % 20)")} AS tc_out,
  CAST(5 + o_orderkey % 20 AS DOUBLE) AS duration_sec, CASE WHEN o_orderkey % 3 = 0 THEN 60.0::DOUBLE ELSE 24.0::DOUBLE END AS fps,
  {ROUNDED} AS quality_score, CAST(1 + o_orderkey % 5 AS DOUBLE) AS visual_quality, CAST(1 + o_custkey % 5 AS DOUBLE) AS stability,
  CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'hello' ELSE '' END AS asr_text,
  ['c' || CAST(o_custkey % 5 AS VARCHAR), 'c' || CAST(o_orderkey % 4 AS VARCHAR)] AS characters,
  CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS sign, 'cam' || CAST(o_orderkey % 3 AS VARCHAR) AS camera_position,
  CASE WHEN o_orderkey % 4 = 0 THEN '未知' ELSE 'pan' END AS camera_movement,
  'loc' || CAST(o_custkey % 4 AS VARCHAR) AS location, 'e' || CAST(o_orderkey % 2 AS VARCHAR) AS emotion,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'walks' END AS action, o_orderkey % 9 = 0 AS slow,
  CASE o_orderkey % 4 WHEN 0 THEN '50%' WHEN 1 THEN '1x' WHEN 2 THEN '200%' ELSE '2.5x' END AS speed,
  CASE o_orderkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 2.5::DOUBLE END AS speed_x FROM orders)"""


def decisions(rows: DataFrame) -> DataFrame:
    """A decision for each shot, in order of idx."""
    plain = {"technique": "连续剪辑", "transition": "硬切", "audio": "保留原声", "purpose": "", "notes": ""}
    return rows.select("project_id", F.col("idx").alias("seq"), "shot_id", "source_file", "tc_in", "tc_out", "speed", *[F.lit(v).alias(k) for k, v in plain.items()])


def segments(scores: DataFrame) -> DataFrame:
    """Two-second segments of each asset whose attributes follow from the highest score in them."""
    s = F.col("seg_seq")
    cut = scores.groupBy("project_id", "asset_id", F.floor(F.col("t_us") / 2_000_000).alias("seg_seq")).agg(F.max("cut_score").alias("top"), F.max("t_us").alias("last"))
    m = F.floor(F.col("top") * 1000) % 3
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return cut.select(
        "project_id", "asset_id", s.alias("seg_seq"), (s * 2_000_000).alias("start_us"), (s * 2_000_000 + 2_000_000).alias("end_us"), text("cam", m).alias("camera_position"),
        F.array(text("c", s % 2)).alias("characters"), text("e", m % 2).alias("emotion"), F.when(s % 3 == 0, "walks home").otherwise("sits").alias("action"),
        text("loc", s % 2).alias("location"), F.lit("").alias("dialogue"), F.round(F.col("top") % 1, 3).alias("coherence_score"), (s % 4 == 3).alias("is_long_take"),
    )


SEGMENTS = """segs AS (SELECT project_id, asset_id, s AS seg_seq, s * 2000000 AS start_us, s * 2000000 + 2000000 AS end_us, m AS cam, s % 2 AS who, m % 2 AS mood,
  CASE WHEN s % 3 = 0 THEN 'walks home' ELSE 'sits' END AS action, s % 2 AS loc, round(top % 1, 3) AS coherence_score, s % 4 = 3 AS is_long_take
  FROM (SELECT *, CAST(floor(top * 1000) AS BIGINT) % 3 AS m FROM
    (SELECT project_id, asset_id, t_us // 2000000 AS s, max(cut_score) AS top FROM fs GROUP BY ALL)))"""
