"""Named queries of documents in lines, of texts that come as lines and of live cut candidates, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from footage_lake.functions.staged import shared_folder
from footage_lake.operators import cuts, scripts, timeline
from footage_lake.plans import bindings as b
from footage_lake.plans.catalog_queries import LAYOUT, PEAKS, _laid
from footage_lake.plans.edit_queries import CODED, EDL, SPINE
from footage_lake.plans.registry import query
from footage_lake.plans.source_queries import CHUNKED
from footage_lake.sources import tables
from footage_lake.streaming.peaks import live_peaks


def _number(c: str):
    return F.col(c).cast("bigint").alias(c)


@query(f"""WITH {b.SHOTS}, n AS (SELECT project_id, shot_id, row_number() OVER (PARTITION BY project_id ORDER BY shot_id) AS k FROM shots)
SELECT project_id, 1::BIGINT AS section, CASE k WHEN 1 THEN '' ELSE ',' END || '{{"shot_id":"' || shot_id || '"}}' AS value FROM n
UNION ALL SELECT DISTINCT project_id, 0, '{{"shots":[' FROM n UNION ALL SELECT DISTINCT project_id, 2, ']}}' FROM n""")
def stage_lines(spark, d):
    """K1: the lines of each project's document, as they are written."""
    return tables.stage_lines(b.shots(spark, d).select("project_id", "shot_id"), "shots").select("project_id", _number("section"), "value")


@query(f"""WITH {CODED}, {EDL}, each AS (SELECT project_id, entry, unnest(range(len(l))) AS nth, unnest(l) AS value FROM lines)
SELECT project_id, 3::BIGINT AS section, entry AS place, nth, value FROM each
UNION ALL SELECT project_id, k, NULL, 0, v FROM (SELECT DISTINCT project_id FROM each), (VALUES (0, 'TITLE: TIMELINE'), (1, 'FCM: NON-DROP FRAME'), (2, '')) AS f(k, v)""")
def edl_document(spark, d):
    """K6: the lines of each project's edit list with its head."""
    return timeline.edl_document(_laid(spark, d)).select("project_id", _number("section"), _number("place"), "nth", "value")


@query(f"""WITH {LAYOUT}, refs AS (SELECT project_id, source_file, row_number() OVER (PARTITION BY project_id ORDER BY min(entry), source_file) + 1 AS ref FROM laid GROUP BY project_id, source_file), spine AS ({SPINE})
SELECT project_id, 3::BIGINT AS section, entry AS place, fragment AS value FROM spine
UNION ALL SELECT project_id, 1, ref, '<asset id="r' || CAST(ref AS VARCHAR) || '" src="/m/' || source_file || '.mov"/>' FROM refs
UNION ALL SELECT project_id, k, NULL, v FROM (SELECT DISTINCT project_id FROM refs), (VALUES (0, '<?xml version="1.0" encoding="UTF-8"?><fcpxml version="1.9"><resources>'), (2, '</resources><spine>'), (4, '</spine></fcpxml>')) AS f(k, v)""")
def xml_document(spark, d):
    """K7: the lines of each project's exchange document."""
    return timeline.xml_document(_laid(spark, d)).select("project_id", _number("section"), _number("place"), "value")


@query(f"WITH RECURSIVE whole AS (SELECT doc_id AS id, text AS body FROM documents), {CHUNKED} SELECT id AS script_id, chunk AS chunk_no, length(piece) AS n_chars, md5(piece) AS md5 FROM pieces")
def line_chunks(spark, d):
    """X4 over documents that come as rows of lines."""
    lines = b.read(spark, d, "documents").select(F.col("doc_id").alias("script_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return scripts.chunked_lines(lines).select("script_id", "chunk_no", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("md5"))


@query(f"WITH {PEAKS} SELECT project_id, asset_id, t_us, round(prominence + 1e-9, 6) AS prominence FROM peaks WHERE is_max AND prominence >= 0.25")
def live_cut_peaks(spark, d):
    """T5, T6 over the frame scores as a stream that starts a day after the epoch (a watermark starts there); a last row far ahead lets the watermark pass all others."""
    day = 86_400_000_000
    folder = shared_folder(spark)
    rows = b.frame_scores(spark, d).select(*cuts.KEYS, F.timestamp_micros(F.col("t_us") + day).alias("at"), "cut_score")
    rows.write.parquet(f"{folder}/scores")
    newest = spark.read.schema(rows.schema).parquet(f"{folder}/scores").agg(F.max("at").alias("at")).where("at IS NOT NULL")
    last = newest.select(F.lit("").alias("project_id"), F.lit("").alias("asset_id"), (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit(0.0).alias("cut_score"))
    last.write.mode("append").parquet(f"{folder}/scores")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/scores")
    peaks = live_peaks(stream)
    run = peaks.writeStream.format("parquet").option("path", f"{folder}/peaks").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(peaks.schema).parquet(f"{folder}/peaks")
    return found.select(*cuts.KEYS, (F.col("t_us") - day).alias("t_us"), F.round(F.col("prominence") + 1e-9, 6).alias("prominence"))
