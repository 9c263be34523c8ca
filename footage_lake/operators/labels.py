"""Stored model responses to rows: fenced JSON, frame labels, segments, votes, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footage_lake.functions.timecode import strip_fence

UNSURE = "无法判断"
#: Fields of a segment and their types.
SEGMENT_FIELDS = {
    "start": "double", "end": "double", "camera_position": "string", "characters": "array<string>", "emotion": "string", "action": "string",
    "location": "string", "dialogue": "string", "coherence_score": "double", "is_long_take": "boolean",
}
SEGMENT = "struct<" + ",".join(f"{n}:{t}" for n, t in SEGMENT_FIELDS.items()) + ">"
#: Label fields: the words that introduce them in free text, and the default.
FRAME_FIELDS = {
    "shot_size": (["景别", "shot_size"], UNSURE),
    "camera_movement": (["运镜", "camera_movement"], UNSURE),
    "location": (["地点", "location"], UNSURE),
    "emotion": (["情绪", "emotion"], UNSURE),
    "action": (["动作", "action"], ""),
    "time_of_day": (["时间", "time_of_day"], UNSURE),
}


def parse_responses(responses: DataFrame, schema: str, column: str = "response") -> DataFrame:
    """Struct ``payload`` of the fenced or bare JSON; null where it does not parse."""
    body = strip_fence(F.col(column))
    good = F.try_parse_json(body).isNotNull()
    return responses.withColumn("payload", F.when(good, F.from_json(body, schema)))


def parse_frame_labels(frames: DataFrame, column: str = "response") -> DataFrame:
    """Label fields from JSON, else from ``景别: ...`` lines, else the default; other keys are dropped."""
    schema = "struct<" + ",".join(f"{k}:string" for k in FRAME_FIELDS) + ">"
    body = strip_fence(F.col(column))
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))
    rows = frames.withColumn("p", parsed)
    out = []
    for name, (words, default) in FRAME_FIELDS.items():
        line = F.trim(F.regexp_extract(column, rf"(?:{'|'.join(words)})\s*[：:]\s*\"?([^\n\",，]+)", 1))
        rescued = F.when((F.length(line) > 0) & F.col("p").isNull(), line)
        out.append(F.coalesce(F.expr(f"nullif(p.{name}, '')"), rescued, F.lit(default)).alias(name))
    return rows.select(*[c for c in frames.columns if c != column], *out)


def segments_from_response(responses: DataFrame) -> DataFrame:
    """Segment rows of each asset's response; without any, one segment over the whole asset."""
    payload = parse_responses(responses, f"struct<segments:array<{SEGMENT}>>")
    more = {n: t for n, t in SEGMENT_FIELDS.items() if n not in ("start", "end")}
    whole = F.array(F.struct(F.lit(0.0).alias("start"), (F.col("duration_us") / 1e6).alias("end"), *[F.lit(None).cast(t).alias(n) for n, t in more.items()]))
    listed = F.when(F.size("payload.segments") > 0, F.col("payload.segments")).otherwise(whole)
    rows = payload.select("project_id", "asset_id", F.posexplode(listed).alias("seg_seq", "s"))
    us = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    rest = [F.col(f"s.{n}") for n in more]
    return rows.select("project_id", "asset_id", "seg_seq", us("s.start").alias("start_us"), us("s.end").alias("end_us"), *rest)


def suggested_cuts(responses: DataFrame) -> DataFrame:
    """S17, second output: the cut points that a response suggests."""
    payload = parse_responses(responses, "struct<suggested_cut_points:array<double>>")
    return payload.select("project_id", "asset_id", F.explode("payload.suggested_cut_points").alias("t")).select(
        "project_id", "asset_id", F.round(F.col("t") * 1e6).cast("bigint").alias("t_us")
    )


def cut_votes_from_response(responses: DataFrame) -> DataFrame:
    """(t_us, is_cut) rows; negative times are dropped."""
    payload = parse_responses(responses, "struct<results:array<struct<timestamp:double,is_cut:boolean>>>")
    rows = payload.select("project_id", "asset_id", F.explode("payload.results").alias("r")).where("r.timestamp >= 0")
    return rows.select("project_id", "asset_id", F.round(F.col("r.timestamp") * 1e6).cast("bigint").alias("t_us"), F.coalesce("r.is_cut", F.lit(False)).alias("is_cut"))


def transcripts(responses: DataFrame) -> DataFrame:
    """Rows (start, end, text) in seconds from millisecond pairs; no stamps give (0, 0), empty texts are dropped.

    ``sentence_info`` is an array of struct<start, end, text>.
    """
    rows = responses.select("project_id", "asset_id", F.posexplode_outer("sentence_info").alias("seq", "s"))
    sec = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / 1000, 2)
    return rows.where(F.length(F.trim(F.coalesce("s.text", F.lit("")))) > 0).select(
        "project_id", "asset_id", "seq", sec("s.start").alias("start_sec"), sec("s.end").alias("end_sec"), F.trim("s.text").alias("text")
    )


def dialogue(rows: DataFrame) -> DataFrame:
    """A5: an asset's texts in order of their start, joined by blanks."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "seq", "text"))), lambda r: r["text"])
    return rows.groupBy("project_id", "asset_id").agg(F.array_join(said, " ").alias("asr_text"))


def vote(frames: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A2: the most common value of a label that is not 无法判断 or empty; ties go to the value seen first."""
    known = frames.where(F.coalesce(F.col(value), F.lit("")).isin("", UNSURE) == F.lit(False))
    n = known.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("votes"))


def longest(frames: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A2: the longest text, ties to the first."""
    return frames.groupBy(*keys).agg(F.max_by(value, F.struct(F.length(value), -F.col(order))).alias(value))


def merged_lists(frames: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A2: all list items once, in the order in which they appear."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda r: r[value])
    return frames.groupBy(*keys).agg(F.array_distinct(F.flatten(rows)).alias(value))


def merge_characters(a: Column, b: Column) -> Column:
    """Names of ``a`` in order, then new ones of ``b``."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def clip_summary(clips: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Persons once in order, 说话 added to the actions of clips with speech, unsure defaults."""
    people = F.array_distinct(F.coalesce("persons", F.array().cast("array<string>")))
    if not keep_unknown:
        people = F.filter(people, lambda p: ~p.startswith("unknown"))
    actions = F.array_distinct(F.coalesce("actions", F.array().cast("array<string>")))
    speech = F.length(F.coalesce("speech", F.lit(""))) > 0
    return clips.withColumns(
        {
            "persons": people,
            "actions": F.when(speech, F.array_union(actions, F.array(F.lit("说话")))).otherwise(actions),
            **{c: F.coalesce(F.expr(f"nullif({c}, '')"), F.lit(UNSURE)) for c in ("shot_size", "emotion") if c in clips.columns},
        }
    )


def labels_to_shot(frames: DataFrame) -> DataFrame:
    """Frame labels under the names of shot fields, without people and dialogue."""
    return frames.select(
        "project_id", "asset_id", "shot_size", "camera_movement", "location", "time_of_day", "emotion", "action",
        F.array().cast("array<string>").alias("characters"), F.lit("").alias("dialogue"),
    )


def batch_document(clips: DataFrame) -> DataFrame:
    """Per batch the number of clips and their summaries in order."""
    return clips.groupBy("batch").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("clip", "persons", "actions"))).alias("videos"))
