"""Media catalogs, probe records, score logs, material states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footage_lake.functions.ordered import numbered
from footage_lake.functions.timecode import frame_rate

VIDEO, IMAGE = ["mp4", "mov", "mkv", "avi", "mxf"], ["jpg", "jpeg", "png"]
DEFAULT_STATE = "RAW"
# Fixed values, S20: sections of a configuration that is given without them, as (section, key, value).
DEFAULTS = [
    ("split_scoring", "weights.camera_change", "0.35"),
    ("split_scoring", "weights.subject_change", "0.25"),
    ("split_scoring", "weights.emotion_break", "0.15"),
    ("split_scoring", "weights.plot_shift", "0.10"),
    ("split_scoring", "weights.action_break", "0.10"),
    ("split_scoring", "weights.dialogue_break", "0.05"),
    ("split_scoring", "thresholds.high", "0.55"),
    ("split_scoring", "thresholds.medium", "0.40"),
    ("split_scoring", "long_take_protection.enabled", "true"),
    ("split_scoring", "long_take_protection.min_duration", "30.0"),
    ("split_scoring", "long_take_protection.threshold_boost", "0.15"),
    ("materials", "0.state", "RAW"),
    ("materials", "0.split", "true"),
    ("materials", "0.analyze", "true"),
]
RAW_FOLDER = "./materials/"


def with_defaults(given: DataFrame) -> DataFrame:
    """Settings (project_id, section, key, value) with the defaults of each section that a project leaves out.

    The default material folder is the project's ``paths.raw_materials``.
    """
    rows = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("key"), F.lit(c).alias("value")) for a, b, c in DEFAULTS])
    folder = F.max(F.when((F.col("section") == "paths") & (F.col("key") == "raw_materials"), F.col("value")))
    projects = given.groupBy("project_id").agg(F.coalesce(folder, F.lit(RAW_FOLDER)).alias("folder"))
    path = F.struct(F.lit("materials").alias("section"), F.lit("0.path").alias("key"), F.col("folder").alias("value"))
    every = projects.select("project_id", F.explode(F.array_append(rows, path)).alias("d")).select("project_id", "d.*")
    missing = every.join(given.select("project_id", "section").distinct(), ["project_id", "section"], "left_anti")
    return given.select("project_id", "section", "key", "value").unionByName(missing.select("project_id", "section", "key", "value"))


def keep_media(files: DataFrame, extensions: list[str] = VIDEO) -> DataFrame:
    """Paths with a wanted extension in either case, one of each that differ in case only, the smallest."""
    wanted = files.where(F.lower("path").rlike(rf"\.(?:{'|'.join(extensions)})$"))
    return wanted.groupBy(F.lower("path").alias("folded")).agg(F.min("path").alias("path")).select("path")


def media_catalog(spark: SparkSession, root: str, extensions: list[str] = VIDEO) -> DataFrame:
    """Files under ``root``; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return keep_media(files.select(F.regexp_replace("path", "^file:", "").alias("path")), extensions).orderBy("path")


PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string>>,format:struct<duration:string,bit_rate:string,size:string>>"


def assets_from_probe(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (assets, errors) of probe records (path, json): the first video stream's facts; no stream or no size is an error."""
    good = F.try_parse_json("json").isNotNull()
    p = records.withColumn("p", F.when(good, F.from_json("json", PROBE)))
    p = p.withColumn("v", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    ok = F.col("v").isNotNull() & F.coalesce((F.col("v.width") > 0) & (F.col("v.height") > 0), F.lit(False))
    assets = p.where(ok).select(
        F.xxhash64("path").cast("string").alias("asset_id"), "path", F.struct(F.col("v.width").alias("w"), F.col("v.height").alias("h")).alias("resolution"),
        F.concat(F.col("v.width").cast("string"), F.lit(":"), F.col("v.height").cast("string")).alias("aspect_ratio"), frame_rate(F.col("v.r_frame_rate")).alias("fps"),
        F.round(F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)) * 1e6).cast("bigint").alias("duration_us"),
        F.col("p.format.bit_rate").alias("bitrate"), F.col("v.codec_name").alias("codec"),
    )
    return assets, p.where(~ok).select("path", F.lit("no readable video stream").alias("error"))


def frame_scores_from_log(lines: DataFrame) -> DataFrame:
    """Scores of log lines (asset_id, line_no, line): a score belongs to the last time before it, once per time."""
    t = F.regexp_extract("line", r"pts_time:([0-9.]+)", 1).try_cast("double")
    s = F.regexp_extract("line", r"lavfi\.scene_score=([0-9.]+)", 1).try_cast("double")
    w = Window.partitionBy("asset_id").orderBy("line_no")
    rows = lines.withColumns({"t": t, "s": s}).withColumns({"at": F.last("t", True).over(w), "seg": F.count("t").over(w)}).where("s IS NOT NULL AND seg > 0")
    first = rows.groupBy("asset_id", "seg").agg(F.min_by("s", "line_no").alias("cut_score"), F.first("at").alias("at"))
    return first.select("asset_id", F.round(F.col("at") * 1e6).cast("bigint").alias("t_us"), "cut_score", F.lit(0.0).alias("hist_score"))


def resolve_state(media: DataFrame, rules: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """State of each path by the first of: global pattern, item pattern (both on the base name), longest directory, RAW.

    Rules (tier 1..3, rule_seq, kind 'regex' or 'dir', pattern, state) are mostly a small
    configuration: up to ``most_rules`` go to every task as one array, so paths are
    neither shuffled nor paired with them. Beyond, each path looks its directories up in
    a join, and only patterns meet all names. A directory matches with its slash.
    """
    if rules.limit(most_rules + 1).count() > most_rules:
        return _resolved_by_joins(media, rules)
    place = F.when(F.col("kind") == "dir", -F.length("pattern")).otherwise(F.col("rule_seq"))
    rule = F.struct("tier", place.alias("place"), "rule_seq", "kind", "pattern", "state")
    held = rules.groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(rule)).alias("held"))
    name = F.element_at(F.split("path", "/"), -1)
    regex = lambda r: F.rlike(name, r["pattern"])
    folder = lambda r: F.startswith("path", F.concat(F.regexp_replace(r["pattern"], "/$", ""), F.lit("/")))
    hit = F.filter("held", lambda r: F.when(r["kind"] == "regex", regex(r)).otherwise(folder(r)))
    rows = media.withColumn("one", F.lit(1)).join(F.broadcast(held), "one", "left")
    return rows.withColumn("state", F.coalesce(F.get(hit, F.lit(0))["state"], F.lit(DEFAULT_STATE))).drop("one", "held")


def _resolved_by_joins(media: DataFrame, rules: DataFrame) -> DataFrame:
    """``resolve_state`` for any number of rules."""
    folder = F.regexp_replace("pattern", "/$", "")
    place = F.when(F.col("kind") == "dir", -F.length("pattern")).otherwise(F.col("rule_seq"))
    ranked = rules.select("kind", "pattern", folder.alias("folder"), F.struct("tier", place.alias("place"), "rule_seq", "kind", "pattern", "state").alias("rule"))
    paths = media.select("path").where("path IS NOT NULL").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    looked = paths.where(F.contains("path", F.lit("/"))).select("path", F.explode(above).alias("folder"))
    of_folder = ranked.where("kind <> 'regex'").groupBy("folder").agg(F.min("rule").alias("rule"))
    named = ranked.where("kind = 'regex'").select(F.col("pattern").alias("wanted"), "rule")
    hits = looked.join(of_folder, "folder").select("path", "rule").unionByName(paths.join(named, F.rlike(F.element_at(parts, -1), F.col("wanted"))).select("path", "rule"))
    first = hits.groupBy("path").agg(F.min("rule").alias("_rule"))
    return media.join(first, "path", "left").select(*media.columns, F.coalesce(F.col("_rule.state"), F.lit(DEFAULT_STATE)).alias("state"))


def collect_assets(parts: list[DataFrame], rules: DataFrame) -> DataFrame:
    """The paths of all folders once, with their states."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return resolve_state(every.dropDuplicates(["path"]), rules)


def dispatch(rows: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows of each state through its handler; rows of other states are left out."""
    out = None
    for state, handle in handlers.items():
        part = handle(rows.where(F.col("state") == state))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: Suffixes of sidecar files, best first.
SIDECARS = ["_config.json", "_meta.json", ".json", "_meta.csv", ".csv"]


def attach_sidecar(media: DataFrame, files: DataFrame, preferred: str | None = None) -> DataFrame:
    """The sidecar of each medium by base name and suffix rank; null without one."""
    order = [preferred, *[s for s in SIDECARS if s != preferred]] if preferred else SIDECARS
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    names = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(s).alias("suffix")) for k, s in enumerate(order)])
    wanted = media.select("path", stem.alias("stem"), F.explode(names).alias("n")).withColumn("side", F.concat("stem", "n.suffix"))
    best = wanted.join(files.select(F.col("path").alias("side")), "side").groupBy("path").agg(F.min_by("side", "n.rank").alias("sidecar"))
    return media.join(best, "path", "left")


def resolve_clip(shots: DataFrame, catalog: DataFrame, folder: str) -> DataFrame:
    """The configured clip, else <shot_id>.mp4 in the folder, else the source, whichever exists first."""
    have = lambda n: catalog.select(F.col("path").alias(n))
    rows = shots.withColumn("own", F.concat(F.lit(folder.rstrip("/") + "/"), "shot_id", F.lit(".mp4")))
    rows = rows.join(have("c1"), F.col("clip_path") == F.col("c1"), "left").join(have("c2"), F.col("own") == F.col("c2"), "left")
    return rows.withColumn("clip", F.coalesce("c1", "c2", "source_path")).drop("own", "c1", "c2")


def inventory_shots(assets: DataFrame) -> DataFrame:
    """A RAW row to review for each asset that could be read."""
    rows = numbered(assets.where("duration_us > 0"), "number", ["project_id"], {"_head": F.substring("path", 1, 12)}, ["path"])
    return rows.select(
        "project_id", F.format_string("S%03d", "number").alias("shot_id"), F.lit("RAW").alias("state"), F.col("path").alias("source_path"),
        F.round(F.col("duration_us") / 1e6, 3).alias("duration_sec"), F.array(F.lit("cv_inventory"), F.lit("no_vlm_analysis")).alias("tags"), F.lit(True).alias("needs_review"),
    )


def whole_shots(assets: DataFrame, state: str = "PROCESSED") -> DataFrame:
    """One shot over each asset."""
    return inventory_shots(assets).withColumns({"state": F.lit(state), "tags": F.array().cast("array<string>"), "needs_review": F.lit(state == "ANALYZED")})
