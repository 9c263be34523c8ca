"""Foreign metadata to shot fields: a registry of content tests and projections.

Files are rows of (path, content). No Python runs on rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Canonical fields and the names under which files give them, best first.
ALIASES = {
    "shot_size": ["shot_size", "shot_type", "景别", "镜头类型", "shot"],
    "camera_position": ["camera_position", "机位", "camera_pos", "position"],
    "camera_movement": ["camera_movement", "运镜", "movement", "camera_move"],
    "framing": ["framing", "构图", "composition"],
    "lighting": ["lighting", "光效", "light"],
    "color_tone": ["color_tone", "色调", "color", "tone"],
    "location": ["location", "scene", "地点", "场景", "place"],
    "time_of_day": ["time_of_day", "time", "时间", "time_of_scene"],
    "characters": ["characters", "roles", "人物", "角色", "actors", "character"],
    "action": ["action", "content", "summary", "动作", "内容", "description", "describe"],
    "action_details": ["action_details", "动作细节", "action_detail", "details"],
    "emotion": ["emotion", "mood", "情绪", "情感", "feeling"],
    "dialogue": ["dialogue", "lines", "台词", "对白", "line"],
    "performance": ["performance", "表演", "acting", "performance_quality"],
    "direction": ["direction", "方向", "screen_direction", "movement_direction"],
    "style": ["style", "风格"],
    "atmosphere": ["atmosphere", "氛围", "mood_atmosphere"],
    "culture": ["culture", "文化", "culture_background"],
    "tags": ["tags", "标签", "tag"],
    "key_objects": ["key_objects", "props", "道具", "objects", "key_props"],
    "is_long_take": ["is_long_take", "long_take", "长镜头", "一镜到底"],
    "coherence_score": ["coherence_score", "连贯性", "coherence"],
    "continuity_score": ["continuity_score", "连续性评分", "continuity"],
    "continuity_notes": ["continuity_notes", "连续性说明", "continuity_note"],
    "duration_sec": ["duration_sec", "duration", "时长"],
    "fps": ["fps", "frame_rate", "帧率"],
    "resolution": ["resolution", "分辨率"],
    "aspect_ratio": ["aspect_ratio", "画幅比", "aspect"],
    "bitrate": ["bitrate", "码率"],
    "codec": ["codec", "编码"],
    "visual_quality": ["visual_quality", "画质", "quality"],
    "tc_in": ["tc_in", "timecode_in", "入点"],
    "tc_out": ["tc_out", "timecode_out", "出点"],
}
LISTS = ["characters", "tags", "key_objects"]
NUMBERS = ["coherence_score", "continuity_score", "duration_sec", "fps", "visual_quality"]


def _at(v: str, name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$[\"{name}\"]', '{kind}')")


def pick(v: str, names: list[str], kind: str = "string") -> Column:
    """the first of the names that holds a value."""
    return F.coalesce(*[_at(v, n, kind) for n in names])


def pick_string(v: str, names: list[str]) -> Column:
    return F.coalesce(pick(v, names), F.lit(""))


def pick_list(v: str, names: list[str]) -> Column:
    """a list of texts, or a text cut at commas."""
    text = F.filter(F.transform(F.split(pick(v, names), ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    each = [F.coalesce(_at(v, n, "array<string>"), F.when(_at(v, n, "string").isNotNull(), text)) for n in names]
    return F.coalesce(*each, F.array().cast("array<string>"))


def pick_float(v: str, names: list[str]) -> Column:
    return F.coalesce(pick(v, names).try_cast("double"), F.lit(0.0))


def pick_bool(v: str, names: list[str]) -> Column:
    return F.coalesce(F.lower(pick(v, names)).isin("true", "yes", "是", "1"), F.lit(False))


def missing_fields(names: list[str]) -> Column:
    """F16: which of the columns are null, empty or an empty list."""
    out = [F.when(F.coalesce(F.length(F.array_join(F.col(n), "")) if n in LISTS else F.length(F.col(n).cast("string")), F.lit(0)) == 0, F.lit(n)) for n in names]
    return F.array_compact(F.array(*out))


def adapt_generic(files: DataFrame) -> DataFrame:
    """All canonical fields of any JSON object through their aliases."""
    rows = files.withColumn("v", F.try_parse_json("content")).where("v IS NOT NULL")
    cols = []
    for name, names in ALIASES.items():
        read = pick_list if name in LISTS else pick_float if name in NUMBERS else pick_bool if name == "is_long_take" else pick_string
        cols.append(read("v", names).alias(name))
    return rows.select("path", *cols).withColumn("missing", missing_fields(["location", "action", "emotion", "shot_size"]))


def adapt_native(files: DataFrame) -> DataFrame:
    """Own configuration: nested shot_config, else top level; action from content_summary, shot_size from shot_type."""
    top = F.try_parse_json("content")
    rows = files.withColumn("top", top).withColumn("v", F.coalesce(F.expr("try_variant_get(top, '$.shot_config', 'variant')"), F.col("top"))).where("top IS NOT NULL")
    s = lambda *n: pick_string("v", list(n))
    return rows.select(
        "path", F.coalesce(_at("top", "shot_id", "string"), F.lit("")).alias("shot_id"), s("action", "content_summary").alias("action"), s("shot_size", "shot_type").alias("shot_size"),
        s("camera_position").alias("camera_position"), s("camera_movement").alias("camera_movement"), s("emotion").alias("emotion"), s("location").alias("location"),
        pick_list("v", ["characters"]).alias("characters"), pick_list("v", ["tags"]).alias("tags"), pick_float("v", ["duration_sec"]).alias("duration_sec"), pick_float("v", ["fps"]).alias("fps"),
        pick_bool("v", ["is_long_take"]).alias("is_long_take"), pick_float("v", ["coherence_score"]).alias("coherence_score"),
    ).withColumn("missing", missing_fields(["action", "emotion", "location", "characters"]))


def adapt_custom(files: DataFrame) -> DataFrame:
    """Objects with filename and description; characters fall back to tags."""
    rows = files.withColumn("v", F.try_parse_json("content")).where("v IS NOT NULL")
    people = pick_list("v", ["characters"])
    return rows.select(
        "path", pick_string("v", ["filename"]).alias("filename"), pick_string("v", ["description"]).alias("action"), pick_string("v", ["location"]).alias("location"),
        pick_string("v", ["emotion"]).alias("emotion"), F.when(F.size(people) > 0, people).otherwise(pick_list("v", ["tags"])).alias("characters"),
        pick_string("v", ["camera_position"]).alias("camera_position"),
    ).withColumn("missing", missing_fields(["location", "emotion"]))


def adapt_csv(rows: DataFrame) -> DataFrame:
    """The first row of each file read with a header (path, row_no, columns); characters cut at commas."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("row_no"))).where("rn = 1").drop("rn", "row_no")
    plain = first.withColumnsRenamed({c: c.lstrip("﻿") for c in first.columns})
    people = F.filter(F.transform(F.split(F.coalesce("characters", F.lit("")), ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    out = plain.withColumn("characters", people)
    return out.withColumn("missing", missing_fields([c for c in out.columns if c not in ("path", "filename")]))


#: Content tests, best first; a test reads path and the parsed variant ``v``.
FORMATS: list[tuple[str, Callable[[], Column]]] = [
    ("native", lambda: _at("v", "shot_id", "string").isNotNull() & (_at("v", "clip_path", "string").isNotNull() | _at("v", "shot_config", "variant").isNotNull())),
    ("custom_v1", lambda: _at("v", "filename", "string").isNotNull() & _at("v", "description", "string").isNotNull()),
    ("csv", lambda: F.lower("path").endswith(".csv")),
    ("generic_json", lambda: F.col("v").isNotNull() & F.col("content").rlike(r"^\s*\{")),
]


def detect_format(files: DataFrame, formats: list[tuple[str, Callable[[], Column]]] | None = None) -> DataFrame:
    """Column ``format``, the first whose test holds; null for none."""
    rows = files.withColumn("v", F.try_parse_json("content"))
    tests = [F.when(F.coalesce(test(), F.lit(False)), name) for name, test in formats or FORMATS]
    return rows.withColumn("format", F.coalesce(*tests)).drop("v")


# The fields of a description record and their types.
DESCRIPTION = {
    "location": "string",
    "time_of_day": "string",
    "characters": "array<string>",
    "action": "string",
    "emotion": "string",
    "dialogue": "string",
    "shot_size": "string",
    "camera_position": "string",
    "camera_movement": "string",
    "visual_quality": "double",
    "stability": "double",
    "exposure": "double",
    "focus": "double",
    "noise": "double",
    "framing": "string",
    "lighting": "string",
    "color_tone": "string",
    "key_objects": "array<string>",
    "style": "string",
    "atmosphere": "string",
    "culture": "string",
    "tags": "array<string>",
    "direction": "string",
    "performance": "string",
    "action_details": "string",
    "continuity_score": "double",
    "continuity_notes": "string",
}
#: Marks that stay null where nobody gave them.
UNRATED = ["visual_quality", "stability", "exposure", "focus", "noise"]


def _plain(name: str, kind: str) -> Column:
    """The value of a field that nobody gave."""
    if name in UNRATED:
        return F.lit(None).cast(kind)
    return F.array().cast(kind) if kind.startswith("array") else F.lit(0.0) if kind == "double" else F.lit("")


def _of(frame: DataFrame, nested: str | None, name: str, kind: str) -> list[Column]:
    """Column ``name`` of the frame or of its record ``nested``, if there is one."""
    if nested is None:
        return [F.col(name).cast(kind)] if name in frame.columns else []
    inner = frame.schema[nested].dataType.fieldNames() if nested in frame.columns else []
    return [F.col(f"{nested}.{name}").cast(kind)] if name in inner else []


def unpack_description(rows: DataFrame, fields: dict[str, str] | None = None, nested: str = "vlm_description") -> DataFrame:
    """Each of the 27 fields from the top level, else from the nested record, else its default."""
    out = {f: F.coalesce(*_of(rows, None, f, t), *_of(rows, nested, f, t), _plain(f, t)) for f, t in (fields or DESCRIPTION).items()}
    return rows.withColumns(out).drop(nested)


def pack_description(rows: DataFrame, fields: dict[str, str] | None = None, nested: str = "vlm_description") -> DataFrame:
    """The 27 fields as one nested record; fields that the rows lack have their defaults."""
    return rows.withColumn(nested, F.struct(*[F.coalesce(*_of(rows, None, f, t), _plain(f, t)).alias(f) for f, t in (fields or DESCRIPTION).items()]))


#: Fields that tags are made of; 未知 is skipped for the first two.
TAG_FIELDS = ["shot_size", "camera_movement", "emotion", "location", "time_of_day", "style"]


def _tags_of(fields: dict[str, Column]) -> Column:
    none = {c: ["", "未知"] if c in TAG_FIELDS[:2] else [""] for c in TAG_FIELDS}
    return F.array_compact(F.array(*[F.when(~F.coalesce(fields[c], F.lit("")).isin(none[c]), fields[c]) for c in TAG_FIELDS]))


def build_tags() -> Column:
    """P10: explicit tags, else the filled ones of six fields."""
    return F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(_tags_of({c: F.col(c) for c in TAG_FIELDS}))


def analyzed_shots(rows: DataFrame, adapter: str) -> DataFrame:
    """Rows never to be split, with review flag, missing fields and provenance."""
    filled = [F.length(F.coalesce(F.col(c), F.lit(""))) > 0 for c in ("action", "emotion", "location")]
    review = ~reduce(lambda a, b: a | b, filled)
    conversion = F.struct(F.lit(adapter).alias("adapter"), missing_fields(["action", "emotion", "location", "characters"]).alias("missing_fields"), review.alias("needs_review"))
    return rows.withColumns({"state": F.lit("ANALYZED"), "do_not_split": F.lit(True), "needs_review": review, "provenance": F.struct(F.lit("ANALYZED").alias("state"), conversion.alias("conversion"))})


# The fields of a shot's configuration from the scan (record, else shot), then from the content.
FROM_SCAN = {"resolution": "struct<w:int,h:int>", "aspect_ratio": "string", "bitrate": "string", "codec": "string", "visual_quality": "double"}
CONTENT_TEXT = [
    "camera_position", "camera_movement", "location", "time_of_day", "action", "emotion", "dialogue", "framing", "lighting", "color_tone",
    "style", "atmosphere", "culture", "direction", "performance", "action_details", "continuity_notes",
]
#: Names under which a content record may give two of the fields, and the shot's column for them.
RENAMED = {"shot_type": (["shot_type", "shot_size"], "shot_size"), "content_summary": (["content_summary", "description", "action"], "action")}


def config_fields(shots: DataFrame, meta: str = "meta", scan: str = "cv", clip: str = "clip_path") -> DataFrame:
    """Record ``shot_config`` of 40 fields per shot.

    ``meta`` and ``scan`` are records of what is in the shot and of its file; their
    values come first, then the shot's columns, then defaults. Records and columns
    that are missing count as null.
    """
    one = lambda name, kind, *more: F.coalesce(*_of(shots, meta, name, kind), *more, *_of(shots, None, name, kind), _plain(name, kind)).alias(name)
    own = lambda name, kind, column=None: F.coalesce(*_of(shots, None, column or name, kind), F.lit(None).cast(kind)).alias(name)
    out = [own("duration_sec", "double"), own("fps", "double")]
    out += [F.coalesce(*_of(shots, scan, n, t), *_of(shots, None, n, t), F.lit(None).cast(t)).alias(n) for n, t in FROM_SCAN.items()]
    for name, (said, column) in RENAMED.items():
        given = [c for n in said for c in _of(shots, meta, n, "string")]
        out.append(F.coalesce(*given, *_of(shots, None, column, "string"), F.lit("")).alias(name))
    out += [one(n, "string") for n in CONTENT_TEXT]
    out += [one(n, "array<string>") for n in ("characters", "key_objects")]
    named = {c: F.coalesce(*(x for n in (RENAMED["shot_type"][0] if c == "shot_size" else [c]) for x in _of(shots, meta, n, "string")), F.lit("")) for c in TAG_FIELDS}
    explicit = F.coalesce(*_of(shots, meta, "tags", "array<string>"), F.array().cast("array<string>"))
    out.append(F.when(F.size(explicit) > 0, explicit).otherwise(_tags_of(named)).alias("tags"))
    out.append(one("continuity_score", "double"))
    out += [own("source_file", "string"), own("source_path", "string"), own("source_tc_in", "string", "tc_in"), own("source_tc_out", "string", "tc_out")]
    out.append(F.coalesce(*_of(shots, None, clip, "string"), F.lit("")).alias("split_clip_path"))
    out.append(F.coalesce(*_of(shots, meta, "is_long_take", "boolean"), F.lit(False)).alias("is_long_take"))
    out.append(F.coalesce(*_of(shots, meta, "coherence_score", "double"), F.lit(0.0)).alias("coherence_score"))
    out += [own("state", "string"), *[F.coalesce(*_of(shots, None, n, "boolean"), F.lit(False)).alias(n) for n in ("do_not_split", "needs_review")]]
    return shots.withColumn("shot_config", F.struct(*out))


def shot_config(shots: DataFrame, **records: str) -> DataFrame:
    """K8: one JSON record per shot: its configuration, id, clip, place in the source, links and key frames."""
    rows = config_fields(shots, **records)
    times = [F.coalesce(*_of(rows, None, n, "string"), F.lit(None).cast("string")).alias(n) for n in ("tc_in", "tc_out")]
    more = [F.col("shot_id"), F.concat("shot_id", F.lit(".mp4")).alias("clip_path"), *times]
    if {"prev", "next"} <= set(rows.columns):
        more.append(F.struct("prev", "next").alias("relationships"))
    if "keyframes" in rows.columns:
        more.append(F.col("keyframes"))
    return rows.select("project_id", "shot_id", F.to_json(F.struct("shot_config.*", *more), {"ignoreNullFields": "false"}).alias("config"))
