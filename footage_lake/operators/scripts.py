"""Screenplay texts: cleaning, scene and chunk splits, outlines to beats and back.

Texts are rows of (script_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footage_lake.functions.ordered import NEVER, SPAN, gated, sums_before

# The forms of a scene heading, at the start of a line.
HEADINGS = [
    r"第\s*[一二三四五六七八九十百零\d]+\s*场[：:.\s]",
    r"第\s*[一二三四五六七八九十百零\d]+\s*章[：:.\s]",
    r"第\s*[一二三四五六七八九十百零\d]+\s*节[：:.\s]",
    r"第\s*[一二三四五六七八九十百零\d]+\s*回[：:.\s]",
    r"第\s*[一二三四五六七八九十百零\d]+\s*集[：:.\s]",
    r"第\s*[一二三四五六七八九十百零\d]+\s*幕[：:.\s]",
    r"场\s*\d+\s*[：:.\s]",
    r"(?:内景|外景|日内|日外|夜内|夜外|晨内|晨外)[\.\\/]",
    r"(?:INT|EXT|INT\./EXT|EXT\./INT)[\.\\/\s]",
    r"Chapter\s+\d+",
    r"Scene\s+\d+",
]
HEADING = "(?m)^(?:" + "|".join(HEADINGS) + ")"
CHUNK = 4000
BEAT = ["act", "scene", "beat_id", "location", "time", "content", "emotion", "key_actions", "key_dialogue", "suggested_shots"]
LABELS = {"location": "地点", "time": "时间", "content": "内容", "emotion": "情绪", "key_actions": "关键动作", "key_dialogue": "关键台词"}


def clean_text(text: Column) -> Column:
    """line ends, lines of page numbers, runs of three or more empty lines, outer blanks."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:第\s*\d+\s*页|\d+|-\s*\d+\s*-)[ \t]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def is_structured(text: Column) -> Column:
    """an outline has acts, beats and bullets."""
    return text.rlike(r"(?m)^##\s") & text.rlike(r"(?m)^###\s") & text.rlike(r"(?m)^-\s")


def chunks(text: Column, most: int = CHUNK) -> Column:
    """Paragraphs gathered up to ``most`` characters, line ends not counted; a longer paragraph stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("len"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["cur"].isNotNull() & (acc["len"] + F.length(p) > most)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["cur"].isNull(), p).otherwise(F.concat(acc["cur"], F.lit("\n"), p)).alias("cur"),
            F.when(full, F.length(p)).otherwise(acc["len"] + F.length(p)).alias("len"),
        )

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))


def chunked_lines(lines: DataFrame, most: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(script_id, chunk_no, chunk) of texts that come as rows (script_id, line_no, line), the rule of ``chunks``.

    A line opens a chunk if it ends more than ``most`` characters after the open chunk began.
    A text is walked in blocks of places (``ordered.gated``), so that no row, array or task
    holds a text; only a chunk's own lines come together. Lines of one number are ordered by
    their text; a null line is empty.
    """
    keys = ["script_id"]
    rows = lines.select("script_id", "line_no", F.coalesce("line", F.lit("")).alias("line")).withColumn("n_chars", F.length("line").cast("bigint"))
    alone = rows.groupBy("script_id", "line_no").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and rows.where("script_id IS NULL OR line_no IS NULL").isEmpty()
    order = ["line_no"] if alone else ["line_no", "line"]
    far = {"_far": F.floor(F.col("line_no") / 10_000).cast("bigint")}
    placed = sums_before(rows.drop("line") if alone else rows, keys, far, order, {"begins": F.col("n_chars")}).withColumn("ends", F.col("begins") + F.col("n_chars"))
    walked = gated(placed, keys, "begins", "ends", most + 1, NEVER, "opens", span)
    opens = F.col("opens").cast("bigint")
    at = sums_before(walked, keys, far, ["begins", "ends", *order], {"chunk_no": opens}).withColumn("chunk_no", F.col("chunk_no") + opens - 1)
    if alone:
        at = at.drop("n_chars").join(rows.drop("n_chars"), ["script_id", "line_no"])
        order = ["line_no", "line"]
    parts = at.groupBy("script_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("begins", "ends", *order))).alias("rows"))
    return parts.select("script_id", "chunk_no", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("chunk"))


def scenes(text: Column) -> Column:
    """Texts between headings, each after its heading on a line of its own; without a heading the chunks.

    What stands before the first heading is a scene; a heading without a body is lost.
    """
    mark = "\u0001"
    parts = F.split(F.regexp_replace(text, f"({HEADING})", f"{mark}$1\u0002"), mark, -1)

    def joined(p: Column) -> Column:
        head, body = F.substring_index(p, "\u0002", 1), F.trim(F.regexp_replace(F.substring_index(p, "\u0002", -1), r"^\s+|\s+$", ""))
        strip = F.regexp_replace(head, r"^\s+|\s+$", "")
        return F.when(~p.contains("\u0002"), F.regexp_replace(p, r"^\s+|\s+$", "")).when(F.length(body) > 0, F.concat(strip, F.lit("\n"), body)).otherwise("")

    found = F.filter(F.transform(parts, joined), lambda s: F.length(s) > 0)
    return F.when(F.size(parts) <= 1, chunks(text)).otherwise(found)


def split_scripts(scripts: DataFrame) -> DataFrame:
    """A row per scene of each cleaned text."""
    return scripts.select("script_id", F.posexplode(scenes(clean_text(F.col("text")))).alias("scene_no", "scene_text"))


def scene_requests(scene_rows: DataFrame, template: str) -> DataFrame:
    """The request text of each scene."""
    return scene_rows.select("script_id", "scene_no", F.replace(F.lit(template), F.lit("{scene_text}"), F.col("scene_text")).alias("request"))


def beats_from_responses(responses: DataFrame) -> DataFrame:
    """Beats of parsed scene responses (script_id, scene_no, payload string), ten fields with defaults.

    A payload is an object with ``beats``, one beat, or a list of beats; anything else gives none.
    """
    kind = "array<struct<" + ",".join(f"{c}:string" for c in BEAT) + ">>"
    v = F.try_parse_json("payload")
    listed = F.when(F.col("payload").rlike(r"^\s*\["), F.col("payload"))
    inner = F.coalesce(F.expr("to_json(try_variant_get(v, '$.beats', 'variant'))"), listed, F.concat(F.lit("["), F.expr("to_json(v)"), F.lit("]")))
    rows = responses.withColumn("v", v).where("v IS NOT NULL").select("script_id", "scene_no", F.col("v"), inner.alias("body"))
    act = F.expr("try_variant_get(v, '$.act', 'string')")
    scene = F.expr("try_variant_get(v, '$.scene', 'string')")
    beats = rows.select("script_id", "scene_no", act.alias("r_act"), scene.alias("r_scene"), F.posexplode(F.from_json("body", kind)).alias("pos", "b"))
    field = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"r_{c}") if c in ("act", "scene") else F.lit(None), F.lit("")).alias(c)
    return beats.select("script_id", "scene_no", "pos", *[field(c) for c in BEAT])


def failed_scripts(scripts: DataFrame, beats: DataFrame) -> DataFrame:
    """Texts that gave no beat."""
    return scripts.select("script_id").join(beats.select("script_id"), "script_id", "left_anti")


def render_outline(beats: DataFrame) -> DataFrame:
    """One outline per script: acts in first-seen order, beats with six bullets and one for suggested shots.

    Beats have script_id, beat_seq and the fields; ``key_actions`` is text joined by ``，``.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    bullets = [F.concat(F.lit(f"- {LABELS[n]}："), c(n)) for n in ("location", "time", "content", "emotion", "key_actions")]
    bullets.append(F.concat(F.lit(f'- {LABELS["key_dialogue"]}："'), c("key_dialogue"), F.lit('"')))
    more = F.when(F.length(c("suggested_shots")) > 0, F.concat(F.lit("- 建议镜头："), c("suggested_shots")))
    block = F.array_join(F.array_compact(F.array(F.concat(F.lit("### "), c("beat_id")), *bullets, more)), "\n")
    first = F.min("beat_seq").over(Window.partitionBy("script_id", "act"))
    rows = beats.select("script_id", c("act").alias("act"), "beat_seq", block.alias("block"), first.alias("act_seq"))
    acts = rows.groupBy("script_id", "act_seq", "act").agg(F.sort_array(F.collect_list(F.struct("beat_seq", "block"))).alias("rows"))
    text = F.concat(F.lit("## "), "act", F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n"))
    docs = acts.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("act_seq", text.alias("text")))).alias("acts"))
    return docs.select("script_id", F.array_join(F.transform("acts", lambda a: a["text"]), "\n\n").alias("text"))


def parse_outline(scripts: DataFrame, action_marks: str = "，、", unquote: bool = True) -> DataFrame:
    """Beats of outlines: ``## `` sets the act, ``### `` starts a beat, bullets up to the next ``#`` line fill it.

    A text is cut at its acts and these at their heads, so a beat is a row as soon as there
    are rows, and no lines are sorted or grouped.
    """
    trimmed = F.array_join(F.transform(F.split("text", "\n", -1), lambda r: F.trim(r)), "\n")
    head = lambda s, at: F.trim(F.substring(F.substring_index(s, "\n", 1), at, 10_000))
    # ?d: only \n ends a line
    in_act = lambda s: F.transform(F.split(s, r"(?md)^(?=#)", -1), lambda b: F.struct(F.when(s.startswith("## "), head(s, 4)).otherwise("").alias("act"), b.alias("body")))
    every = F.filter(F.flatten(F.transform(F.split(trimmed, r"(?md)^(?=## )", -1), in_act)), lambda b: b["body"].startswith("### "))
    rows = scripts.select("script_id", F.posexplode(every).alias("pos", "b")).select("script_id", (F.col("pos") + 1).cast("bigint").alias("beat_seq"), "b.act", "b.body")
    bullet = r"^-\s*([^：:\s]+)[：:]\s*(.+)$"
    said_lines = F.filter(F.split("body", "\n", -1), lambda r: r.startswith("-"))
    told = F.transform(said_lines, lambda r: F.struct(F.regexp_extract(r, bullet, 1).alias("key"), F.trim(F.regexp_extract(r, bullet, 2)).alias("value")))
    rows = rows.select("script_id", "beat_seq", "act", head(F.col("body"), 5).alias("beat_id"), told.alias("told"))
    # the last bullet of a name counts
    last = lambda n: F.try_element_at(F.filter("told", lambda t: t["key"] == n), F.lit(-1))["value"]
    pick = lambda *names: F.coalesce(*[last(n) for n in names], F.lit(""))
    said = pick("关键台词", "dialogue")
    if unquote:
        said = F.regexp_replace(said, '^"(.*)"$', "$1")
    beats = rows.select(
        "script_id", "beat_seq", "act", "beat_id", pick("地点", "location").alias("location"), pick("时间", "time").alias("time"), pick("内容", "content").alias("content"), pick("情绪", "emotion").alias("emotion"),
        pick("关键动作").alias("actions"), said.alias("key_dialogue"),
    )
    actions = F.filter(F.transform(F.split("actions", f"[{action_marks}]"), lambda a: F.trim(a)), lambda a: F.length(a) > 0)
    return beats.select(
        "script_id", "beat_seq", "act", F.substring_index("beat_id", "-", 1).alias("scene"), "beat_id", "location", "time", "content", "emotion",
        actions.alias("key_actions"), "key_dialogue",
    )
