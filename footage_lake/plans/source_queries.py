"""Named queries of sources, adapters, stored responses, records and scripts, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from footage_lake.functions.timecode import act_number
from footage_lake.operators import anchors, cuts, edit, labels, quality, scripts
from footage_lake.plans import bindings as b
from footage_lake.plans.catalog_queries import _marked
from footage_lake.plans.registry import query
from footage_lake.sources import adapters, catalog, tables


def _text(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


# ---------------------------------------------------------------- media


@query("""SELECT '/m/' || CAST(page_id % 50 AS VARCHAR) || '.MOV' AS path FROM pages WHERE page_id % 3 = 0 GROUP BY ALL UNION SELECT '/m/' || CAST(page_id % 50 AS VARCHAR) || '.mp4' FROM pages WHERE page_id % 3 = 1""")
def kept_media(spark, d):
    k = F.col("page_id")
    paths = b.read(spark, d, "pages").select(F.concat(_text("/m/", k % 50), F.when(k % 3 == 0, F.when(k % 2 == 0, ".mov").otherwise(".MOV")).when(k % 3 == 1, ".mp4").otherwise(".txt")).alias("path"))
    upper = paths.where("path LIKE '%.mov'").select(F.replace("path", F.lit(".mov"), F.lit(".MOV")).alias("path"))
    return catalog.keep_media(paths.unionByName(upper))


def _probed(spark, d):
    k = F.col("page_id")
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":'), (k % 5 * 320).cast("string"), F.lit(',"height":720,"r_frame_rate":"'), (24 + k % 3).cast("string"), F.lit('000/1000"}'))
    streams = F.when(k % 7 == 3, F.lit('{"codec_type":"audio"}')).otherwise(F.concat(F.lit('{"codec_type":"audio"},'), video))
    said = F.concat(F.lit('{"streams":['), streams, F.lit('],"format":{"duration":"'), k.cast("string"), F.lit('.25","bit_rate":"5000"}}'))
    return b.read(spark, d, "pages").select(_text("/m/", k).alias("path"), F.when(k % 11 == 0, "no json").otherwise(said).alias("json"))


PROBED = "page_id % 5 <> 0 AND page_id % 7 <> 3 AND page_id % 11 <> 0"


@query(f"""SELECT '/m/' || CAST(page_id AS VARCHAR) AS path, CAST(page_id % 5 * 320 AS INT) AS w, 720 AS h, CAST(page_id % 5 * 320 AS VARCHAR) || ':720' AS aspect_ratio, CAST(24 + page_id % 3 AS DOUBLE) AS fps, page_id * 1000000 + 250000 AS duration_us, '5000' AS bitrate, 'h264' AS codec FROM pages WHERE {PROBED}""")
def probed_assets(spark, d):
    return catalog.assets_from_probe(_probed(spark, d))[0].select("path", "resolution.w", "resolution.h", "aspect_ratio", "fps", "duration_us", "bitrate", "codec")


@query(f"SELECT '/m/' || CAST(page_id AS VARCHAR) AS path, 'no readable video stream' AS error FROM pages WHERE NOT ({PROBED})")
def probe_errors(spark, d):
    return catalog.assets_from_probe(_probed(spark, d))[1]


@query(f"""WITH a AS (SELECT *, page_id * 1000000 + 250000 AS us FROM pages WHERE {PROBED}) SELECT 'p' || CAST(page_id % 4 AS VARCHAR) AS project_id, printf('S%03d', row_number() OVER (PARTITION BY page_id % 4 ORDER BY '/m/' || CAST(page_id AS VARCHAR))) AS shot_id,
'RAW' AS state, '/m/' || CAST(page_id AS VARCHAR) AS source_path, page_id + 0.25::DOUBLE AS duration_sec, true AS needs_review FROM a""")
def inventory_shots(spark, d):
    assets = catalog.assets_from_probe(_probed(spark, d))[0]
    rows = assets.withColumn("project_id", _text("p", F.substring("path", 4, 9).cast("int") % 4))
    return catalog.inventory_shots(rows).drop("tags")


@query("""WITH n AS (SELECT CAST(user_id AS VARCHAR) AS asset_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)
SELECT asset_id, (rn - 1) * 100000 AS t_us, (event_id % 1000) / 1000.0::DOUBLE AS cut_score FROM n WHERE rn % 3 = 1""")
def score_log(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = b.read(spark, d, "events").withColumn("rn", F.row_number().over(w) - 1)
    at = F.concat(F.lit("frame pts_time:"), F.expr("cast(rn div 10 AS string)"), F.lit("."), (F.col("rn") % 10).cast("string"))
    score = F.concat(F.lit("lavfi.scene_score=0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    lines = rows.select(F.col("user_id").cast("string").alias("asset_id"), F.col("rn").alias("line_no"), F.when(F.col("rn") % 3 == 0, at).otherwise(score).alias("line"))
    return catalog.frame_scores_from_log(lines).drop("hist_score")


@query("""SELECT '/m/f' || CAST(page_id AS VARCHAR) || '.mov' AS path, CASE WHEN page_id % 2 = 0 THEN '/m/f' || CAST(page_id AS VARCHAR) || '_meta.json' WHEN page_id % 3 = 0 THEN '/m/f' || CAST(page_id AS VARCHAR) || '.json' WHEN page_id % 5 = 0 THEN '/m/f' || CAST(page_id AS VARCHAR) || '.csv' END AS sidecar FROM pages""")
def sidecars(spark, d):
    pages, k = b.read(spark, d, "pages"), F.col("page_id")
    name = _text("/m/f", k)
    part = lambda m, suffix: pages.where(k % m == 0).select(F.concat(name, F.lit(suffix)).alias("path"))
    files = part(2, "_meta.json").unionByName(part(3, ".json")).unionByName(part(5, ".csv"))
    return catalog.attach_sidecar(pages.select(F.concat(name, F.lit(".mov")).alias("path")), files)


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/own/' || CAST(page_id AS VARCHAR) WHEN page_id % 2 = 0 THEN '/clips/S' || CAST(page_id AS VARCHAR) || '.mp4' ELSE url END AS clip FROM pages""")
def resolved_clips(spark, d):
    pages, k = b.read(spark, d, "pages"), F.col("page_id")
    shots = pages.select("page_id", _text("S", k).alias("shot_id"), _text("/own/", k).alias("clip_path"), F.col("url").alias("source_path"))
    there = pages.where("page_id % 3 = 0").select(_text("/own/", k).alias("path")).unionByName(pages.where("page_id % 2 = 0").select(F.concat(_text("/clips/S", k), F.lit(".mp4")).alias("path")))
    return catalog.resolve_clip(shots, there, "/clips/").select("page_id", "clip")


@query("""SELECT '/raw/' || CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 10 = 7 THEN 'ANALYZED' WHEN page_id % 10 = 3 THEN 'PROCESSED' WHEN page_id % 2 = 0 THEN 'ANALYZED' ELSE 'RAW' END AS state, CASE WHEN page_id % 10 = 7 OR page_id % 10 <> 3 AND page_id % 2 = 0 THEN 'analyzed' WHEN page_id % 10 = 3 THEN 'processed' ELSE 'raw' END AS handler
FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT '/raw/even/' || CAST(page_id AS VARCHAR), 'ANALYZED', 'analyzed' FROM pages WHERE page_id % 2 = 0""")
def dispatched_states(spark, d):
    pages, k = b.read(spark, d, "pages"), F.col("page_id")
    rules = spark.createDataFrame([(1, 0, "regex", "7$", "ANALYZED"), (2, 0, "regex", "^[0-9]*3$", "PROCESSED"), (3, 0, "dir", "/raw", "RAW"), (3, 1, "dir", "/raw/even", "ANALYZED")], "tier int, rule_seq int, kind string, pattern string, state string")
    odd, even = pages.where(k % 2 == 1).select(_text("/raw/", k).alias("path")), pages.where(k % 2 == 0).select(_text("/raw/even/", k).alias("path"))
    rows = catalog.collect_assets([odd, even, odd.where("path LIKE '%1'")], rules)
    mark = lambda name: lambda part: part.withColumn("handler", F.lit(name))
    return catalog.dispatch(rows, {"RAW": mark("raw"), "PROCESSED": mark("processed"), "ANALYZED": mark("analyzed")})


@query("""WITH p AS (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS project_id, c_custkey AS k FROM customer)
SELECT project_id, 'paths' AS section, 'raw_materials' AS key, '/raw/' || project_id AS value FROM p
UNION ALL SELECT project_id, 'split_scoring', 'thresholds.high', '0.9' FROM p WHERE k % 3 = 0
UNION ALL SELECT project_id, 'split_scoring', unnest(['weights.camera_change', 'weights.subject_change', 'weights.emotion_break', 'weights.plot_shift', 'weights.action_break', 'weights.dialogue_break', 'thresholds.high', 'thresholds.medium', 'long_take_protection.enabled', 'long_take_protection.min_duration', 'long_take_protection.threshold_boost']),
 unnest(['0.35', '0.25', '0.15', '0.10', '0.10', '0.05', '0.55', '0.40', 'true', '30.0', '0.15']) FROM p WHERE k % 3 <> 0
UNION ALL SELECT project_id, 'materials', unnest(['0.state', '0.split', '0.analyze', '0.path']), unnest(['RAW', 'true', 'true', '/raw/' || project_id]) FROM p""")
def config_defaults(spark, d):
    c = b.read(spark, d, "customer").select(_text("c", F.col("c_custkey")).alias("project_id"), "c_custkey")
    paths = c.select("project_id", F.lit("paths").alias("section"), F.lit("raw_materials").alias("key"), F.concat(F.lit("/raw/"), "project_id").alias("value"))
    own = c.where("c_custkey % 3 = 0").select("project_id", F.lit("split_scoring").alias("section"), F.lit("thresholds.high").alias("key"), F.lit("0.9").alias("value"))
    return catalog.with_defaults(paths.unionByName(own))


# ---------------------------------------------------------------- foreign metadata


def _files(spark, d):
    """A file per event: native, custom, csv, generic and unreadable ones."""
    k, e = F.col("event_id"), F.col("event_type")
    q = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    people = F.concat(F.lit('["a'), (k % 4).cast("string"), F.lit('","b"]'))
    native = obj(q("shot_id", _text("S", k)), q("clip_path", _text("/c/", k)), q("content_summary", e), q("shot_type", _text("size", k % 2)), q("emotion", e), F.concat(F.lit('"fps":'), (24 + k % 2).cast("string")), F.concat(F.lit('"characters":'), people), F.lit('"is_long_take":true'))
    custom = obj(q("filename", _text("f", k)), q("description", e), q("location", _text("loc", k % 3)), F.concat(F.lit('"tags":'), people))
    kind = k % 5
    content = F.when(kind == 0, native).when(kind == 1, custom).when(kind == 2, "a,b").when(kind == 3, obj(q("地点", e), q("人物", F.lit("x, y")))).otherwise("plain")
    return b.read(spark, d, "events").select(F.concat(_text("/x/", k), F.when(kind == 2, ".CSV").otherwise(".json")).alias("path"), content.alias("content"), kind.alias("kind"))


@query("SELECT '/x/' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 5 = 2 THEN '.CSV' ELSE '.json' END AS path, CASE event_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'custom_v1' WHEN 2 THEN 'csv' WHEN 3 THEN 'generic_json' END AS format FROM events")
def detected_formats(spark, d):
    return adapters.detect_format(_files(spark, d)).select("path", "format")


@query("""SELECT event_id, 'S' || CAST(event_id AS VARCHAR) AS shot_id, event_type AS action, 'size' || CAST(event_id % 2 AS VARCHAR) AS shot_size, event_type AS emotion, '' AS location, 'a' || CAST(event_id % 4 AS VARCHAR) || ',b' AS characters, 24.0::DOUBLE + event_id % 2 AS fps, true AS is_long_take, 'location' AS missing FROM events WHERE event_id % 5 = 0""")
def adapter_native(spark, d):
    rows = adapters.adapt_native(_files(spark, d).where("kind = 0"))
    return rows.select(F.substring("shot_id", 2, 20).cast("bigint").alias("event_id"), "shot_id", "action", "shot_size", "emotion", "location", F.array_join("characters", ",").alias("characters"), "fps", "is_long_take", F.array_join("missing", ",").alias("missing"))


@query("""SELECT 'f' || CAST(event_id AS VARCHAR) AS filename, event_type AS action, 'loc' || CAST(event_id % 3 AS VARCHAR) AS location, '' AS emotion, 'a' || CAST(event_id % 4 AS VARCHAR) || ',b' AS characters, 'emotion' AS missing FROM events WHERE event_id % 5 = 1""")
def adapter_custom(spark, d):
    return adapters.adapt_custom(_files(spark, d).where("kind = 1")).select("filename", "action", "location", "emotion", F.array_join("characters", ",").alias("characters"), F.array_join("missing", ",").alias("missing"))


@query("""SELECT CAST(user_id AS VARCHAR) AS path, arg_min(event_type, event_id) AS emotion, 'a|b' AS characters, CASE WHEN user_id % 4 = 0 THEN 'location' ELSE '' END AS missing FROM events GROUP BY user_id""")
def adapter_csv(spark, d):
    e = b.read(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("row_no"), F.lit("a, b,").alias("characters"), F.col("event_type").alias("emotion"), F.when(F.col("user_id") % 4 != 0, "L").alias("location"))
    return adapters.adapt_csv(rows.withColumnRenamed("emotion", "﻿emotion")).select("path", "emotion", F.array_join("characters", "|").alias("characters"), F.array_join("missing", ",").alias("missing"))


@query("""SELECT event_id, event_type AS location, 'x,y' AS characters, 0.5::DOUBLE AS coherence_score, 25.0::DOUBLE AS fps, true AS is_long_take, event_id % 2 = 0 AS has_dialogue, 'size' AS shot_size, CASE WHEN event_id % 3 = 0 THEN 'emotion' ELSE 'action,emotion' END AS missing FROM events""")
def adapter_generic_fields(spark, d):
    k = F.col("event_id")
    said = F.to_json(F.create_map(F.lit("场景"), F.col("event_type"), F.lit("actors"), F.lit("x, ,y"), F.lit("连贯性"), F.lit("0.5"), F.lit("帧率"), F.lit("25"), F.lit("一镜到底"), F.lit("是"), F.lit("台词"), F.when(k % 2 == 0, "hm").otherwise(""), F.lit("shot"), F.lit("size"), F.lit("describe"), F.when(k % 3 == 0, "d").otherwise("")))
    rows = adapters.adapt_generic(b.read(spark, d, "events").select(k.cast("string").alias("path"), said.alias("content")))
    return rows.select(F.col("path").cast("bigint").alias("event_id"), "location", F.array_join("characters", ",").alias("characters"), "coherence_score", "fps", "is_long_take", (F.col("dialogue") != "").alias("has_dialogue"), "shot_size", F.array_join("missing", ",").alias("missing"))


def _described(spark, d):
    """Shots whose description is partly in the nested record."""
    shots = b.shots(spark, d)
    nested = F.struct(F.lit("night").alias("time_of_day"), F.when(F.col("idx") % 3 == 0, F.array(F.lit("cup"))).alias("key_objects"), F.lit("nested").alias("emotion"), (F.col("idx") % 7).cast("double").alias("focus"))
    return shots.withColumn("emotion", F.when(F.col("idx") % 2 == 0, F.col("emotion"))).withColumn("vlm_description", nested)


@query(f"""WITH {b.SHOTS} SELECT project_id, shot_id, CASE WHEN idx % 2 = 0 THEN emotion ELSE 'nested' END AS emotion, 'night' AS time_of_day, CASE WHEN idx % 3 = 0 THEN 'cup' ELSE '' END AS key_objects, CAST(idx % 7 AS DOUBLE) AS focus, NULL::DOUBLE AS noise, 0.0::DOUBLE AS continuity_score, '' AS style, location FROM shots""")
def unpacked_descriptions(spark, d):
    rows = adapters.unpack_description(adapters.pack_description(adapters.unpack_description(_described(spark, d))).drop("emotion", "time_of_day", "key_objects", "focus", "noise", "continuity_score", "style", "location"))
    return rows.select("project_id", "shot_id", "emotion", "time_of_day", F.array_join("key_objects", ",").alias("key_objects"), "focus", "noise", "continuity_score", "style", "location")


@query(f"""WITH {b.SHOTS} SELECT project_id, shot_id, duration_sec, 'h264' AS codec, CASE WHEN idx % 2 = 0 THEN 'wide' ELSE 'size' || CAST(idx % 2 AS VARCHAR) END AS shot_type, 'said' AS content_summary, location, CASE WHEN idx % 2 = 0 THEN 'wide,' ELSE '' END || 'calm' AS tags,
tc_in AS source_tc_in, '/c/' || shot_id AS split_clip_path, idx % 5 = 0 AS is_long_take, 0.0::DOUBLE AS coherence_score, state, false AS needs_review, visual_quality, action FROM shots""")
def shot_configs(spark, d):
    k = F.col("idx")
    meta = F.struct(F.when(k % 2 == 0, "wide").alias("shot_size"), F.lit("said").alias("description"), F.lit("calm").alias("emotion"), F.when(k % 5 == 0, F.lit(True)).alias("is_long_take"))
    rows = b.shots(spark, d).withColumns({"meta": meta, "cv": F.struct(F.lit("h264").alias("codec")), "clip_path": F.concat(F.lit("/c/"), "shot_id")})
    names = ["duration_sec", "codec", "shot_type", "content_summary", "location", "source_tc_in", "split_clip_path", "is_long_take", "coherence_score", "state", "needs_review", "visual_quality", "action"]
    c = adapters.config_fields(rows)
    return c.select("project_id", "shot_id", *[F.col(f"shot_config.{n}") for n in names], F.array_join("shot_config.tags", ",").alias("tags"))


@query(f"""WITH {b.SHOTS} SELECT shot_id, shot_id || '.mp4' AS clip_path, tc_in, source_file, duration_sec, location FROM shots""")
def config_records(spark, d):
    said = adapters.shot_config(b.shots(spark, d))
    kept = F.from_json("config", "shot_id string, clip_path string, tc_in string, source_file string, duration_sec double, location string")
    return said.select(kept.alias("c")).select("c.*")


@query(f"""WITH {b.SHOTS} SELECT shot_id, CASE WHEN slow THEN '慢动作' ELSE 'size' || CAST(idx % 2 AS VARCHAR) || CASE WHEN idx % 4 = 0 THEN '' ELSE ',pan' END || ',' || emotion || ',' || location || ',day' END AS tags FROM shots""")
def built_tags(spark, d):
    rows = b.shots(spark, d).withColumns({"time_of_day": F.lit("day"), "style": F.lit("")})
    return rows.select("shot_id", F.array_join(adapters.build_tags(), ",").alias("tags"))


@query(f"""WITH {b.SHOTS} SELECT shot_id, 'ANALYZED' AS state, true AS do_not_split, idx % 7 = 0 AND idx % 2 = 0 AS needs_review, CASE WHEN idx % 7 = 0 THEN 'action' || CASE WHEN idx % 2 = 0 THEN ',emotion,location' ELSE '' END ELSE CASE WHEN idx % 2 = 0 THEN 'emotion,location' ELSE '' END END AS missing FROM shots""")
def analyzed_shots(spark, d):
    bare = lambda c: F.when(F.col("idx") % 2 == 0, "").otherwise(F.col(c))
    rows = adapters.analyzed_shots(b.shots(spark, d).withColumns({"emotion": bare("emotion"), "location": bare("location")}), "native")
    return rows.select("shot_id", "state", "do_not_split", "needs_review", F.array_join("provenance.conversion.missing_fields", ",").alias("missing"))


@query(f"""WITH {b.SHOTS} SELECT DISTINCT 'p' || CAST(o_custkey % 16 AS VARCHAR) AS project_id, 'f' || CAST(o_custkey AS VARCHAR) AS asset_id, CASE WHEN o_custkey % 2 = 0 THEN 1000000 ELSE 0 END::BIGINT AS start_us, CASE WHEN o_custkey % 2 = 0 THEN 2000000 ELSE 9000000 END::BIGINT AS end_us FROM orders""")
def rough_cuts_of_assets(spark, d):
    """Assets of equal names in other projects have rough cuts that are not theirs."""
    k = F.col("o_custkey")
    assets = b.read(spark, d, "orders").select(_text("p", k % 16).alias("project_id"), _text("f", k).alias("asset_id"), F.lit(9_000_000).cast("bigint").alias("duration_us"), k).distinct()
    rough = assets.where(k % 2 == 0).select("project_id", "asset_id", F.lit(1_000_000).cast("bigint").alias("start_us"), F.lit(2_000_000).cast("bigint").alias("end_us"))
    foreign = rough.withColumns({"project_id": F.lit("other"), "start_us": F.lit(5).cast("bigint")})
    return tables.rough_shots_for(rough.unionByName(foreign), assets.drop("o_custkey")).drop("duration_us")


@query(f"""WITH {b.SHOTS} SELECT project_id, count(*) AS n, md5(string_agg(shot_id, ',' ORDER BY shot_id)) AS md5 FROM shots GROUP BY project_id""")
def stage_documents(spark, d):
    docs = tables.stage_documents(b.shots(spark, d).select("project_id", "shot_id"), "shots")
    ids = F.transform(F.from_json("value", "shots array<struct<shot_id:string>>")["shots"], lambda s: s["shot_id"])
    return docs.select("project_id", F.size(ids).cast("bigint").alias("n"), F.md5(F.array_join(ids, ",")).alias("md5"))


# ---------------------------------------------------------------- stored responses


@query("""SELECT lang AS project_id, CAST(doc_id AS VARCHAR) AS shot_id, CASE WHEN doc_id // 20 % 7 = 0 THEN 'ERROR' WHEN doc_id % 9 = 0 THEN 'UNMATCHED' ELSE 'b' || CAST(doc_id % 12 AS VARCHAR) END AS beat,
CASE WHEN doc_id // 20 % 7 = 0 OR doc_id % 9 = 0 THEN '' ELSE 'act' END AS act, CASE WHEN doc_id // 20 % 7 = 0 OR doc_id % 9 = 0 THEN 0 ELSE doc_id % 10 / 10.0 END::DOUBLE AS confidence FROM documents""")
def anchor_responses(spark, d):
    k = F.col("doc_id")
    docs = b.read(spark, d, "documents").select(F.col("lang").alias("project_id"), F.expr("doc_id div 20").alias("batch"), k.cast("string").alias("shot_id"), k)
    beat = F.concat(F.lit('"'), F.when(k % 2 == 0, "beat").otherwise("matched_beat"), F.lit('":"b'), (k % 12).cast("string"), F.lit('"'))
    item = F.concat(F.lit('{"shot_id":"'), "shot_id", F.lit('",'), beat, F.lit(',"matched_act":"act","confidence":'), (k % 10 / 10).cast("string"), F.lit("}"))
    text = F.concat(F.lit("["), F.array_join(F.collect_list(F.when(k % 9 != 0, item)), ","), F.lit("]"))
    responses = docs.groupBy("project_id", "batch").agg(text.alias("response")).withColumn("response", F.when(F.col("batch") % 7 == 0, "oops").otherwise(F.col("response")))
    return anchors.anchors_from_responses(docs.drop("doc_id"), responses).select("project_id", "shot_id", "beat", "act", "confidence")


@query("""SELECT project_id, batch, count(*) AS n_rows, 'Rows:' || chr(10) || string_agg(text, chr(10) ORDER BY pos) AS request FROM (SELECT lang AS project_id, doc_id // 10 AS batch, doc_id AS pos, left(md5(text), 6) AS text FROM documents) GROUP BY ALL""")
def built_requests(spark, d):
    rows = b.read(spark, d, "documents").select(F.col("lang").alias("project_id"), F.expr("doc_id div 10").alias("batch"), F.col("doc_id").alias("pos"), F.left(F.md5("text"), F.lit(6)).alias("text"))
    return anchors.build_requests(rows, "Rows:\n{rows}")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'near' ELSE '无法判断' END AS emotion, CASE event_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'street' ELSE '无法判断' END AS location, CASE event_id % 3 WHEN 1 THEN 'walks' ELSE '' END AS action FROM events""")
def frame_labels(spark, d):
    k = F.col("event_id")
    said = F.when(k % 3 == 0, F.concat(F.lit('```json\n{"emotion":"'), "event_type", F.lit('","location":"L","other":1}\n```'))).when(k % 3 == 1, "情绪：near\nlocation: street, night\n动作: walks").otherwise("no idea")
    return labels.parse_frame_labels(b.read(spark, d, "events").select("event_id", said.alias("response"))).select("event_id", "emotion", "location", "action")


def _responses(spark, d):
    k = F.col("event_id")
    said = F.concat(F.lit('{"segments":[{"start":0,"end":'), (1 + k % 3).cast("string"), F.lit(',"emotion":"'), "event_type", F.lit('"},{"start":'), (1 + k % 3).cast("string"), F.lit(',"end":5.5}],"suggested_cut_points":[1.5,'), (2 + k % 3).cast("string"), F.lit('],"results":[{"timestamp":-1,"is_cut":true},{"timestamp":0.5},{"timestamp":'), (k % 4).cast("string"), F.lit(',"is_cut":true}]}'))
    return b.read(spark, d, "events").select(F.lit("p").alias("project_id"), k.cast("string").alias("asset_id"), F.lit(5_500_000).alias("duration_us"), F.when(k % 6 == 5, "sorry").otherwise(said).alias("response"))


@query("""SELECT CAST(event_id AS VARCHAR) AS asset_id, 0::BIGINT AS seg_seq, 0::BIGINT AS start_us, CASE WHEN event_id % 6 = 5 THEN 5500000 ELSE (1 + event_id % 3) * 1000000 END::BIGINT AS end_us, CASE WHEN event_id % 6 <> 5 THEN event_type END AS emotion FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 1, (1 + event_id % 3) * 1000000, 5500000, NULL FROM events WHERE event_id % 6 <> 5""")
def response_segments(spark, d):
    return labels.segments_from_response(_responses(spark, d)).select("asset_id", F.col("seg_seq").cast("bigint").alias("seg_seq"), "start_us", "end_us", "emotion")


@query("""SELECT CAST(event_id AS VARCHAR) AS asset_id, unnest([1500000, (2 + event_id % 3) * 1000000]) AS t_us FROM events WHERE event_id % 6 <> 5""")
def suggested_cuts(spark, d):
    return labels.suggested_cuts(_responses(spark, d)).select("asset_id", "t_us")


@query("""SELECT CAST(event_id AS VARCHAR) AS asset_id, unnest([500000, event_id % 4 * 1000000]) AS t_us, unnest([false, true]) AS is_cut FROM events WHERE event_id % 6 <> 5""")
def response_votes(spark, d):
    return labels.cut_votes_from_response(_responses(spark, d)).select("asset_id", "t_us", "is_cut")


@query("""SELECT CAST(conv_id AS VARCHAR) AS asset_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE WHEN turn % 3 = 0 THEN 0 ELSE round(turn * 1004 / 1000.0, 2) END::DOUBLE AS start_sec, round((turn * 1000 + 500) / 1000.0, 2)::DOUBLE AS end_sec, trim(text, ' ') AS text FROM conversations QUALIFY length(trim(text, ' ')) > 0""")
def transcript_rows(spark, d):
    turn = F.col("turn")
    said = F.struct(turn, F.struct(F.when(turn % 3 != 0, turn * 1004).alias("start"), (turn * 1000 + 500).alias("end"), "text").alias("s"))
    rows = b.read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["s"]).alias("sentence_info"))
    out = labels.transcripts(rows.select(F.lit("p").alias("project_id"), F.col("conv_id").cast("string").alias("asset_id"), "sentence_info"))
    return out.select("asset_id", F.col("seq").cast("bigint").alias("seq"), "start_sec", "end_sec", "text")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS persons, CASE WHEN o_orderkey % 3 = 0 THEN 'walks,说话' ELSE 'walks' END AS actions, CASE WHEN o_orderkey % 5 = 0 THEN '无法判断' ELSE 'calm' END AS emotion, '无法判断' AS shot_size FROM orders""")
def clip_summaries(spark, d):
    k = F.col("o_orderkey")
    rows = b.read(spark, d, "orders").select(
        k, F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("unknown3"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"))).alias("persons"), F.array(F.lit("walks"), F.lit("walks")).alias("actions"),
        F.when(k % 3 == 0, "hi").alias("speech"), F.when(k % 5 == 0, "").otherwise("calm").alias("emotion"), F.lit(None).cast("string").alias("shot_size"),
    )
    out = labels.clip_summary(rows)
    return out.select("o_orderkey", F.array_join("persons", ",").alias("persons"), F.array_join("actions", ",").alias("actions"), "emotion", "shot_size")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS merged, any_value(top) AS longest FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) JOIN (SELECT user_id, arg_max(event_type, (length(event_type), -event_id)) AS top FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def merged_labels(spark, d):
    rows = b.read(spark, d, "events")
    lists = labels.merged_lists(rows.withColumn("items", F.array("event_type")), ["user_id"], "event_id", "items")
    most = labels.longest(rows, ["user_id"], "event_id", "event_type").withColumnRenamed("event_type", "longest")
    both = lists.join(most, "user_id")
    return both.select("user_id", F.array_join(labels.merge_characters(F.col("items"), F.array("longest")), ",").alias("merged"), "longest")


@query("""SELECT CAST(o_orderkey % 100 AS BIGINT) AS batch, count(*) AS "count", md5(string_agg('S' || CAST(o_orderkey AS VARCHAR), ',' ORDER BY 'S' || CAST(o_orderkey AS VARCHAR))) AS md5 FROM orders GROUP BY ALL""")
def batch_documents(spark, d):
    k = F.col("o_orderkey")
    rows = b.read(spark, d, "orders").select((k % 100).alias("batch"), _text("S", k).alias("clip"), F.array(F.lit("a")).alias("persons"), F.array(F.lit("b")).alias("actions"))
    return labels.batch_document(rows).select("batch", "count", F.md5(F.array_join(F.transform("videos", lambda v: v["clip"]), ",")).alias("md5"))


@query(f"""WITH {b.SHOTS} SELECT shot_id, CASE WHEN duration_sec <= 0 THEN 0 WHEN duration_sec < 1 THEN 0.3 WHEN duration_sec <= 30 THEN 1.0 ELSE 0.8 END::DOUBLE AS by_length, visual_quality / 5 AS by_mark, (CASE WHEN camera_movement <> '未知' THEN 1 ELSE 0 END + CASE WHEN action <> '' THEN 1 ELSE 0 END + 5) / 7.0::DOUBLE AS filled FROM shots""")
def quality_parts(spark, d):
    return b.shots(spark, d).select("shot_id", quality.duration_score(F.col("duration_sec")).alias("by_length"), quality.normalize_1_5(F.col("visual_quality")).alias("by_mark"), quality.metadata_completeness().alias("filled"))


@query(f"""WITH {b.SHOTS} SELECT project_id, shot_id, count(*) FILTER (WHERE idx % 3 <> 0) OVER () > 0 AS any_left, CASE WHEN idx % 3 = 0 THEN 'UNMATCHED' ELSE beat END AS beat, CASE WHEN idx % 3 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS confidence FROM shots""")
def attached_anchors(spark, d):
    shots = b.shots(spark, d)
    known = shots.where("idx % 3 <> 0").select("project_id", "shot_id", "beat", F.lit("a").alias("act"), F.lit("f").alias("function"), F.lit(0.5).alias("confidence"))
    return anchors.attach_anchors(shots, known).select("project_id", "shot_id", F.lit(True).alias("any_left"), "beat", "confidence")


@query(f"WITH {b.SHOTS} SELECT project_id, count(*) FILTER (WHERE beat <> 'UNMATCHED' AND state = 'ANALYZED') AS n_review, count(*) FILTER (WHERE beat <> 'UNMATCHED') AS n_edit FROM shots GROUP BY project_id")
def edit_pool_sizes(spark, d):
    main, spare = edit.edit_pools(_marked(spark, d).withColumn("status", F.when(F.col("status") == "候选", "备选").otherwise(F.col("status"))))
    rows = main.unionByName(spare)
    return rows.groupBy("project_id").agg(F.count_if(F.col("status") == "待复核").alias("n_review"), F.count("*").alias("n_edit"))


# ---------------------------------------------------------------- scripts

OUTLINE = """SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY first_seen, k) AS beat_seq, act, 'loc' || CAST(k % 5 AS VARCHAR) AS location, 's' || CAST(k AS VARCHAR) AS key_dialogue FROM
(SELECT 'c' || CAST(o_custkey AS VARCHAR) AS script_id, o_orderkey AS k, '第' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || '幕' AS act, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 3) AS first_seen FROM orders)"""


@query(OUTLINE)
def outline_roundtrip(spark, d):
    k = F.col("o_orderkey")
    beats = b.read(spark, d, "orders").select(
        _text("c", F.col("o_custkey")).alias("script_id"), k.alias("beat_seq"), F.concat(_text("第", k % 3 + 1), F.lit("幕")).alias("act"), _text("场1-", k).alias("beat_id"), _text("loc", k % 5).alias("location"), F.lit("夜").alias("time"),
        _text("n", k).alias("content"), F.lit("静").alias("emotion"), F.lit("走，看").alias("key_actions"), _text("s", k).alias("key_dialogue"), F.lit("").alias("suggested_shots"),
    )
    back = scripts.parse_outline(scripts.render_outline(beats))
    return back.select("script_id", F.col("beat_seq").cast("bigint").alias("beat_seq"), "act", "location", "key_dialogue")


CHUNKED = """lines AS (SELECT id, k, p FROM (SELECT id, unnest(range(len(l))) AS k, unnest(l) AS p FROM (SELECT id, string_split(body, chr(10)) AS l FROM whole))),
walk AS (SELECT id, 0::BIGINT AS k, length(p)::BIGINT AS len, 0::BIGINT AS chunk FROM lines WHERE k = 0
  UNION ALL SELECT l.id, l.k, CASE WHEN w.len + length(p) > 4000 THEN length(p) ELSE w.len + length(p) END, CASE WHEN w.len + length(p) > 4000 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN lines l ON l.id = w.id AND l.k = w.k + 1),
pieces AS (SELECT l.id, w.chunk, string_agg(p, chr(10) ORDER BY l.k) AS piece FROM lines l JOIN walk w ON w.id = l.id AND w.k = l.k GROUP BY ALL)"""


@query(f"WITH RECURSIVE whole AS (SELECT doc_id AS id, text AS body FROM documents), {CHUNKED} SELECT id AS script_id, chunk AS chunk_no, length(piece) AS n_chars, md5(piece) AS md5 FROM pieces")
def text_chunks(spark, d):
    docs = b.read(spark, d, "documents").select(F.col("doc_id").alias("script_id"), F.posexplode(scripts.chunks(F.col("text"))).alias("chunk_no", "c"))
    return docs.select("script_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("md5"))


def _screenplays(spark, d):
    """Documents; every third as two scenes, with page numbers between."""
    t = F.col("text")
    return b.read(spark, d, "documents").select(F.col("doc_id").alias("script_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("第一场：\n"), t, F.lit("\n 12 \n\n\n\nScene 2\r\n"), t)).otherwise(t).alias("text"))


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
CLEAN = "trim(" + STRIP.format(x=r"regexp_replace(regexp_replace(regexp_replace(raw, '\r\n?', chr(10), 'g'), '(?m)^[ \t]*(?:第\s*\d+\s*页|\d+|-\s*\d+\s*-)[ \t]*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + ", ' ')"
HEAD = r"(?m)^(?:第\s*[一二三四五六七八九十百零\d]+\s*[场章节回集幕][：:.\s]|场\s*\d+\s*[：:.\s]|(?:内景|外景|日内|日外|夜内|夜外|晨内|晨外)[\.\\/]|(?:INT|EXT|INT\./EXT|EXT\./INT)[\.\\/\s]|Chapter\s+\d+|Scene\s+\d+)"


@query(f"""WITH RECURSIVE cleaned AS (SELECT doc_id AS id, {CLEAN} AS body FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '第一场：' || chr(10) || text || chr(10) || ' 12 ' || chr(10) || chr(10) || chr(10) || chr(10) || 'Scene 2' || chr(13) || chr(10) || text ELSE text END AS raw FROM documents)),
parts AS (SELECT id, body, string_split(regexp_replace(body, '({HEAD})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS l FROM cleaned),
whole AS (SELECT id, body FROM parts WHERE len(l) <= 1), {CHUNKED},
heads AS (SELECT id, k, CASE WHEN NOT contains(p, chr(2)) THEN {STRIP.format(x='p')} WHEN length({STRIP.format(x="split_part(p, chr(2), 2)")}) > 0 THEN {STRIP.format(x="split_part(p, chr(2), 1)")} || chr(10) || trim({STRIP.format(x="split_part(p, chr(2), 2)")}, ' ') ELSE '' END AS scene
  FROM (SELECT id, unnest(range(len(l))) AS k, unnest(l) AS p FROM parts WHERE len(l) > 1))
SELECT id AS script_id, chunk AS scene_no, length(piece) AS n_chars, md5(piece) AS md5 FROM pieces
UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1, length(scene), md5(scene) FROM heads WHERE scene <> ''""")
def scene_split(spark, d):
    rows = scripts.split_scripts(_screenplays(spark, d))
    return rows.select("script_id", F.col("scene_no").cast("bigint").alias("scene_no"), F.length("scene_text").cast("bigint").alias("n_chars"), F.md5("scene_text").alias("md5"))


@query("""SELECT doc_id AS script_id, doc_id % 3 = 0 AS structured, 'Split: ' || left(md5(text), 4) AS request FROM documents""")
def scene_requests(spark, d):
    docs = b.read(spark, d, "documents").select(F.col("doc_id").alias("script_id"), F.lit(0).alias("scene_no"), F.left(F.md5("text"), F.lit(4)).alias("scene_text"), F.when(F.col("doc_id") % 3 == 0, "## a\n### b\n- c").otherwise("## a\n- c").alias("outline"))
    asked = scripts.scene_requests(docs, "Split: {scene_text}")
    return docs.select("script_id", scripts.is_structured(F.col("outline")).alias("structured")).join(asked.select("script_id", "request"), "script_id")


def _payloads(spark, d):
    k = F.col("o_orderkey")
    beat = lambda n: F.concat(F.lit('{"beat_id":"'), n, F.lit('","content":"c"}'))
    one, two = beat(_text("a", k)), beat(_text("b", k))
    said = F.when(k % 4 == 0, F.concat(F.lit('{"act":"A","scene":"S","beats":['), one, F.lit(","), two, F.lit("]}"))).when(k % 4 == 1, one).when(k % 4 == 2, F.concat(F.lit("["), two, F.lit("]"))).otherwise("bad")
    return b.read(spark, d, "orders").select(k.alias("script_id"), F.lit(0).alias("scene_no"), said.alias("payload"))


@query("""SELECT o_orderkey AS script_id, 0::BIGINT AS pos, CASE WHEN o_orderkey % 4 = 2 THEN 'b' ELSE 'a' END || CAST(o_orderkey AS VARCHAR) AS beat_id, CASE WHEN o_orderkey % 4 = 0 THEN 'A' ELSE '' END AS act, CASE WHEN o_orderkey % 4 = 0 THEN 'S' ELSE '' END AS scene, 'c' AS content, '' AS emotion FROM orders WHERE o_orderkey % 4 <> 3
UNION ALL SELECT o_orderkey, 1, 'b' || CAST(o_orderkey AS VARCHAR), 'A', 'S', 'c', '' FROM orders WHERE o_orderkey % 4 = 0""")
def response_beats(spark, d):
    return scripts.beats_from_responses(_payloads(spark, d)).select("script_id", F.col("pos").cast("bigint").alias("pos"), "beat_id", "act", "scene", "content", "emotion")


@query("SELECT o_orderkey AS script_id FROM orders WHERE o_orderkey % 4 = 3")
def failed_scripts(spark, d):
    rows = _payloads(spark, d)
    return scripts.failed_scripts(rows, scripts.beats_from_responses(rows))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 2 WHEN 2 THEN 20 ELSE 99 END AS act_no FROM documents""")
def act_numbers(spark, d):
    forms = F.array(F.lit("第十二幕：x"), F.lit("第2幕"), F.lit("第二十幕"), F.lit("尾声"))
    return b.read(spark, d, "documents").select("doc_id", act_number(F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int"))).alias("act_no"))


@query("""WITH fs AS (SELECT 'p' || CAST(user_id % 8 AS VARCHAR) AS project_id, CAST(user_id AS VARCHAR) AS asset_id, count(*) AS n FROM events GROUP BY ALL)
SELECT project_id, 'S' || asset_id AS shot_id, unnest(range(n)) AS frame_seq, unnest(range(n)) * 2.0::DOUBLE AS at_sec FROM (SELECT project_id, asset_id, CAST(floor(n / 20.0) AS BIGINT) AS n FROM fs) WHERE n >= 1 UNION ALL SELECT project_id, 'S' || asset_id, 0, round(n / 10.0 * 0.5, 3) FROM fs WHERE floor(n / 20.0) < 1""")
def keyframes_by_step(spark, d):
    rows = b.frame_scores(spark, d).groupBy(*cuts.KEYS).agg((F.count("*") / 10).alias("duration_sec")).withColumn("shot_id", F.concat(F.lit("S"), "asset_id"))
    return cuts.keyframe_plan(rows, 2.0).select("project_id", "shot_id", F.col("frame_seq").cast("bigint").alias("frame_seq"), "at_sec")
