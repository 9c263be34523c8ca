"""Timeline rows, EDL lines and exchange rows from final decisions.

Decisions have project_id, sequence (1..n), shot_id, tc_in, tc_out, speed, technique,
transition, audio, notes; shots have source_file, source_path, fps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footage_lake.functions.ordered import numbered, sums_before
from footage_lake.functions.timecode import export_speed, reel_name, sec_to_tc, tc_to_sec
from footage_lake.sources.tables import framed, whole


def matched(decisions: DataFrame, shots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """L1: decisions that have a shot and, where a catalog is given, an existing file."""
    s = shots.select("project_id", "shot_id", "source_file", "source_path", "fps")
    rows = decisions.drop("source_file").join(s, ["project_id", "shot_id"])
    return rows if files is None else rows.join(files.select(F.col("path").alias("source_path")), "source_path", "left_semi")


def layout(rows: DataFrame, fps: float = 24.0) -> DataFrame:
    """Played length and the place of each decision on the timeline, microsecond-rounded."""
    speed = export_speed(F.col("speed"))
    length = (tc_to_sec(F.col("tc_out"), F.col("fps")) - tc_to_sec(F.col("tc_in"), F.col("fps"))) / F.when(speed != 0, speed).otherwise(1.0)
    rows = rows.withColumn("speed_x", speed).withColumn("len_us", F.round(F.coalesce(length, F.lit(0.0)) * 1e6).cast("bigint"))
    rows = sums_before(rows, ["project_id"], {"_block": F.floor(F.col("sequence") / 1000)}, ["sequence", "shot_id"], {"start_us": F.col("len_us"), "entry": F.lit(1)})
    rows = rows.withColumn("end_us", F.col("start_us") + F.col("len_us")).withColumn("entry", (F.col("entry") + 1).cast("int"))
    return rows.withColumn("rec_in", sec_to_tc(F.col("start_us") / 1e6, fps)).withColumn("rec_out", sec_to_tc(F.col("end_us") / 1e6, fps))


def edl_lines(rows: DataFrame) -> DataFrame:
    """L4, K6: text lines of each event, comments only where they apply, numbered in the project."""
    event = F.format_string(
        "%03d  %-8s  V     C        %s %s %s %s", "entry", reel_name(F.col("source_file")), "tc_in", "tc_out", "rec_in", "rec_out"
    )
    note = lambda word, c, plain: F.when(~F.col(c).isin(*plain), F.concat(F.lit(f"* {word}: "), F.col(c)))
    lines = F.array_compact(
        F.array(
            event,
            F.when(F.col("speed_x") != 1, F.format_string("* SPEED: %.1f%%", F.col("speed_x") * 100)),
            F.concat(F.lit("* FROM CLIP NAME: "), F.col("source_file")),
            note("TECHNIQUE", "technique", ["连续剪辑"]),
            note("TRANSITION", "transition", ["硬切"]),
            note("AUDIO", "audio", ["保留原声", "保留"]),
            note("NOTES", "notes", [""]),
            F.lit(""),
        )
    )
    return layout(rows).select("project_id", "entry", F.posexplode(lines).alias("line_no", "line"))


def edl_document(rows: DataFrame, title: str = "TIMELINE") -> DataFrame:
    """K6: the EDL document of each project in lines, for ``write_lines``."""
    lines = edl_lines(rows).select("project_id", F.lit(3).alias("section"), F.col("entry").alias("place"), F.col("line_no").cast("bigint").alias("nth"), F.col("line").alias("value"))
    return framed(lines, rows, {0: f"TITLE: {title}", 1: "FCM: NON-DROP FRAME", 2: ""})


def edl_text(rows: DataFrame, title: str = "TIMELINE") -> DataFrame:
    """One EDL document per project, in a row."""
    return whole(edl_document(rows, title), "\n")


def timeline_entries(rows: DataFrame) -> DataFrame:
    """K5: a row per entry of the timeline document."""
    return layout(rows).select(
        "project_id", "entry", "shot_id", "source_file", F.struct("tc_in", "tc_out").alias("source"), F.struct("rec_in", "rec_out").alias("record"),
        "speed", "technique", "transition", "audio", "notes",
    )


def xml_assets(rows: DataFrame) -> DataFrame:
    """Distinct source files numbered by first use in the project."""
    used = layout(rows).groupBy("project_id", "source_file").agg(F.min("entry").alias("first_entry"), F.min("source_path").alias("source_path"))
    used = numbered(used, "number", ["project_id"], {"_block": F.floor(F.col("first_entry") / 1000)}, ["first_entry", "source_file"])
    return used.select("project_id", F.concat(F.lit("r"), (F.col("number") + 1).cast("string")).alias("asset_ref"), "source_file", "source_path")


def _escaped(c: str):
    out = F.col(c)
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    return out


def xml_spine(rows: DataFrame) -> DataFrame:
    """Ordered clip elements, with a speed element where it is not 1 and a dissolve before a 叠化."""
    clips = layout(rows).join(xml_assets(rows).select("project_id", "source_file", "asset_ref"), ["project_id", "source_file"])
    seconds = lambda c: F.concat(F.col(c).cast("string"), F.lit("/1000000s"))
    rate = F.when(F.col("speed_x") != 1, F.format_string('<timeMap speed="%.2f"/>', "speed_x")).otherwise(F.lit(""))
    clip = F.concat(
        F.lit('<asset-clip name="'), _escaped("shot_id"), F.lit('" ref="'), F.col("asset_ref"), F.lit('" offset="'), seconds("start_us"), F.lit('" duration="'),
        seconds("len_us"), F.lit('">'), rate, F.lit("</asset-clip>"),
    )
    dissolve = F.when(F.col("transition") == "叠化", F.lit('<transition name="Cross Dissolve" duration="1s"/>'))
    return clips.select("project_id", "entry", F.array_join(F.array_compact(F.array(dissolve, clip)), "").alias("fragment"))


def xml_document(rows: DataFrame) -> DataFrame:
    """K7: the exchange document of each project in lines, assets by their number, clips by their entry, for ``write_lines``."""
    number = F.substring("asset_ref", 2, 10).cast("int")
    asset = F.concat(F.lit('<asset id="'), "asset_ref", F.lit('" src="'), _escaped("source_path"), F.lit('"/>'))
    line = lambda section, place, value: ["project_id", F.lit(section).alias("section"), place.alias("place"), F.lit(0).cast("bigint").alias("nth"), value.alias("value")]
    lines = xml_assets(rows).select(*line(1, number, asset)).unionByName(xml_spine(rows).select(*line(3, F.col("entry"), F.col("fragment"))))
    head = '<?xml version="1.0" encoding="UTF-8"?><fcpxml version="1.9"><resources>'
    return framed(lines, rows, {0: head, 2: "</resources><spine>", 4: "</spine></fcpxml>"})


def xml_text(rows: DataFrame) -> DataFrame:
    """One exchange document per project, in a row."""
    return whole(xml_document(rows), "")


def final_rows(rows: DataFrame) -> DataFrame:
    """K4: the thirteen columns of the final table, renumbered, with an empty review column."""
    r = layout(rows)
    names = {"entry": "序号", "shot_id": "镜头ID", "source_file": "源文件", "tc_in": "入点", "tc_out": "出点", "speed": "速度", "technique": "剪辑手法", "transition": "转场", "audio": "音频", "purpose": "目的", "notes": "备注", "rec_in": "时间线入点"}
    return r.select(*[F.col(c).alias(n) for c, n in names.items()], F.lit("").alias("审核意见")).orderBy("序号")
