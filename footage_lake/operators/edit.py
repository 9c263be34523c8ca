"""Edit decisions and the duration budget.

Decisions have project_id, seq, shot_id, speed, notes and more; shots have
duration_sec, fps, state, status, quality_score, tags, camera_movement. A decision
without a shot stays as it is and counts by its time codes. The extension depends on
what was written before, so its rows are walked in order; the total that a step needs is
held in nanoseconds, so that blocks of a project can be walked by themselves (see
``ordered.scanned``).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from footage_lake.functions.ordered import RUN, beside, few, numbered, scanned, sums_before
from footage_lake.functions.staged import staged
from footage_lake.functions.timecode import act_number, parse_duration, parse_speed, scene_number, tc_span
from footage_lake.operators.dedup import ALTERNATE, CORE, PROTECTED, REVIEW

SLOW_TAGS = ["升格", "子弹时间", "bullet_time", "slow_motion", "慢动作"]
DELETE = "删除"
DEFAULTS = {"speed": "1x", "technique": "连续剪辑", "transition": "硬切", "audio": "保留原声", "purpose": "", "notes": ""}
HELD = [PROTECTED, REVIEW]


def edit_pools(shots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shots that may be edited, and of those the alternates that may fill gaps."""
    kept = shots.where(F.col("status").isin(CORE, ALTERNATE, PROTECTED, REVIEW, "保留"))
    return kept.where(F.col("status") != ALTERNATE), kept.where(F.col("status") == ALTERNATE)


def _narrative() -> dict[str, Column]:
    """Act, scene and beat, by which shots are told."""
    return {"act_no": act_number(F.col("act")), "scene_no": scene_number(F.col("beat")), "of_beat": F.col("beat")}


def narrative_order(shots: DataFrame) -> DataFrame:
    """Number by act, scene, beat and time code in the project."""
    place = _narrative()
    rows = shots.withColumns({k: place[k] for k in ("act_no", "scene_no")})
    return numbered(rows, "narrative_no", ["project_id"], place, ["tc_in", "shot_id"])


def default_decisions(shots: DataFrame) -> DataFrame:
    """A plain decision for each shot."""
    return shots.select("project_id", F.col("seq"), "shot_id", "source_file", "tc_in", "tc_out", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()])


def decisions_from_responses(responses: DataFrame, shots: DataFrame) -> DataFrame:
    """Rows of parsed responses (array ``items``); unknown shots go, keep=false or 删除 becomes a noted delete."""
    item = responses.select("project_id", F.posexplode("items").alias("seq", "d"))
    rows = item.select("project_id", "seq", "d.*").join(shots.select("project_id", "shot_id", "source_file", "tc_in", "tc_out"), ["project_id", "shot_id"])
    cut = (F.coalesce("keep", F.lit(True)) == F.lit(False)) | (F.coalesce("speed", F.lit("")) == DELETE)
    plain = {k: F.coalesce(F.expr(f"nullif({k}, '')"), F.lit(v)) for k, v in DEFAULTS.items()}
    plain["notes"] = F.when(cut, F.concat(F.coalesce("notes", F.lit("")), F.lit(" [建议删除]"))).otherwise(F.coalesce("notes", F.lit("")))
    plain["speed"] = F.when(cut, F.lit(DELETE)).otherwise(plain["speed"])
    return rows.select("project_id", "seq", "shot_id", "source_file", "tc_in", "tc_out", *[c.alias(k) for k, c in plain.items()])


def _with_shot(decisions: DataFrame, shots: DataFrame, columns: list[str]) -> DataFrame:
    """Decisions with columns ``s_*`` of their shots, null where there is no shot; ``s_found`` tells."""
    s = shots.select("project_id", "shot_id", *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("s_found"))
    return decisions.join(s, ["project_id", "shot_id"], "left").withColumn("s_found", F.coalesce("s_found", F.lit(False)))


def protect(decisions: DataFrame, shots: DataFrame) -> DataFrame:
    """Deletes of protected and review shots play at 1x, other deletes and unknown shots go."""
    rows = _with_shot(decisions, shots, ["status"]).where("s_found")
    cut, held = F.col("speed") == DELETE, F.coalesce(F.col("s_status").isin(*HELD), F.lit(False))
    notes = F.when(cut & held, F.concat("notes", F.lit(" [保护素材，不删除]"))).otherwise(F.col("notes"))
    return rows.where(~cut | held).withColumn("notes", notes).withColumn("speed", F.when(cut, "1x").otherwise(F.col("speed"))).drop("s_status", "s_found")


def guard_speed(decisions: DataFrame, shots: DataFrame, min_fps: float = 60.0) -> DataFrame:
    """Slow motion under ``min_fps`` plays at 1x, unless the shot is PROCESSED."""
    rows = _with_shot(decisions, shots, ["fps", "state"])
    slow = (parse_speed(F.col("speed")) < 1) & (F.col("s_fps") < min_fps) & (F.coalesce("s_state", F.lit("")) != "PROCESSED")
    slow = F.coalesce(slow, F.lit(False))
    notes = F.when(slow, F.concat("notes", F.lit(" [帧率不足，禁止升格]"))).otherwise(F.col("notes"))
    return rows.withColumn("notes", notes).withColumn("speed", F.when(slow, "1x").otherwise(F.col("speed"))).drop("s_fps", "s_state", "s_found")


def played(duration: Column, speed: Column) -> Column:
    """Seconds on the timeline; null for deleted and impossible speeds."""
    m = parse_speed(speed)
    return F.when(m > 0, duration / m)


def _length(rows: DataFrame) -> Column:
    """Seconds that a decision plays: of its shot, else of its time codes; 0 where it does not play."""
    return F.coalesce(played(F.when(F.col("s_found"), F.col("s_duration_sec")).otherwise(tc_span(F.col("tc_in"), F.col("tc_out"))), F.col("speed")), F.lit(0.0))


def projected_duration(decisions: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """Total per project, by the shots' seconds, or by time codes at 24 frames where there is no shot or none are given."""
    if shots is None:
        rows = decisions.withColumn("len", played(tc_span(F.col("tc_in"), F.col("tc_out")), F.col("speed")))
    else:
        rows = _with_shot(decisions, shots, ["duration_sec"])
        rows = rows.withColumn("len", _length(rows))
    return rows.groupBy("project_id").agg(F.round(F.coalesce(F.sum("len"), F.lit(0.0)), 6).alias("total_sec"))


def compress_speed(decisions: DataFrame, shots: DataFrame) -> DataFrame:
    """Every unprotected decision that has a shot and is slower than 2x goes to 200 %."""
    rows = _with_shot(decisions, shots, ["status"])
    up = F.col("s_found") & ~F.coalesce(F.col("s_status"), F.lit("")).isin(*HELD) & F.coalesce(parse_speed(F.col("speed")) < 2, F.lit(False))
    notes = F.when(up, F.concat("notes", F.lit(" [自动压缩: 提速到200%以控制总时长]"))).otherwise(F.col("notes"))
    return rows.withColumn("notes", notes).withColumn("speed", F.when(up, "200%").otherwise(F.col("speed"))).drop("s_status", "s_found")


def compress_drop(decisions: DataFrame, shots: DataFrame, most: Column) -> DataFrame:
    """Unprotected shots go, with all their decisions, by rising quality until the project's total is at most ``most``.

    The total only falls, so what goes is a prefix of that order: a shot goes if the
    total without the shots before it is still too long. Decisions without a shot
    have quality 0. ``most`` may read project columns.
    """
    rows = _with_shot(decisions, shots, ["status", "duration_sec", "quality_score"])
    rows = rows.withColumn("len", _length(rows)).withColumn("most", most)
    held = F.coalesce(F.col("s_status"), F.lit("")).isin(*HELD)
    of_shot = rows.groupBy("project_id", "shot_id").agg(
        F.sum("len").alias("len"), F.min("seq").alias("first_seq"), F.max(F.coalesce("s_quality_score", F.lit(0.0))).alias("quality"), F.max(held).alias("held"), F.max("most").alias("most")
    )
    length = F.round(F.col("len") * NANO).cast("bigint")
    whole = of_shot.groupBy("project_id").agg(F.sum(length).alias("whole"))
    ranked = sums_before(of_shot, ["project_id"], {"_quality": F.floor(F.col("quality") * 1000)}, ["quality", "first_seq", "shot_id"], {"gone": F.when(F.col("held"), F.lit(0)).otherwise(length)})
    ranked = ranked.join(whole, "project_id").withColumn("too_long", (F.col("whole") - F.col("gone")) / NANO > F.col("most"))
    dropped = ranked.where("too_long AND NOT held").select("project_id", "shot_id")
    return decisions.join(dropped, ["project_id", "shot_id"], "left_anti")


def is_special_slow(tags: Column, fps: Column, movement: Column, min_fps: float = 60.0) -> Column:
    """tagged, fast enough, or said to be slow motion."""
    tagged = F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in SLOW_TAGS]))
    return F.coalesce(tagged, F.lit(False)) | (fps >= min_fps) | F.coalesce(movement, F.lit("")).rlike("升格|子弹时间")


def _placed(decisions: DataFrame) -> DataFrame:
    """Decisions with their ``p_place`` in the project, from 1: by seq, then shot_id; rows equal in both in any one order."""
    return numbered(decisions, "p_place", ["project_id"], {"_block": F.floor(F.col("seq") / 1000)}, ["seq", "shot_id", "speed", "tc_in"])


def slow_caps(decisions: DataFrame, shots: DataFrame, min_fps: float = 60.0) -> DataFrame:
    """How far each decision's shot may be stretched: 4x, 1.5x next to two specials, 1x under ``min_fps``; null: not at all.

    Adds the decision's ``p_place`` in the project, by seq, then shot_id.
    """
    rows = _with_shot(decisions, shots, ["duration_sec", "fps", "state", "tags", "camera_movement"])
    special = F.coalesce(is_special_slow(F.col("s_tags"), F.col("s_fps"), F.col("s_camera_movement"), min_fps), F.lit(False))
    rows = rows.withColumn("special", F.col("s_found") & special)
    rows = _placed(rows)
    rows = beside(rows, ["project_id"], "p_place", {"near": F.col("special").cast("int")}, 2)
    near = F.col("near")
    cap = F.when(F.col("s_fps") < min_fps, 1.0).when(F.col("special") & (near >= 2), 1.5).when(F.col("special"), 4.0).otherwise(2.0)
    may = F.col("s_found") & (F.coalesce("s_state", F.lit("")) != "PROCESSED")
    return rows.withColumn("cap", F.when(may, cap)).drop("special", "near", "s_fps", "s_state", "s_tags", "s_camera_movement")


def written_speed(x: float) -> tuple[str, float]:
    """A speed as ``format_speed`` writes it, and what that text says."""
    if abs(x - 1) < 0.01:
        return "1x", 1.0
    if x < 1:
        return f"{round(x * 100)}%", round(x * 100) / 100
    if abs(x - round(x)) < 0.01:
        return f"{round(x)}x", float(round(x))
    tenth = Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP)
    return f"{tenth}x", float(tenth)


#: Parts of a second in which totals are held.
NANO = 1_000_000_000


def _slowed(decisions: DataFrame, shots: DataFrame, least: Column, min_fps: float, run: int = RUN) -> DataFrame:
    """E8, with ``p_played``: the seconds that each decision then plays. Guessed: shots play to their caps."""
    rows = slow_caps(decisions, shots, min_fps).withColumn("p_least", least)
    rows = staged(rows.withColumn("p_was", _length(rows)))
    totals = rows.groupBy("project_id").agg(F.round(F.sum("p_was"), 6).alias("p_total"))
    m = parse_speed(F.col("speed"))
    rows = rows.join(totals, "project_id").withColumn("p_now", F.col("s_duration_sec") / F.when(m > 0, m).otherwise(F.lit(1.0)))

    def step(total, speed, duration, cap, now, was, least):
        deficit = (round(least * NANO) - total) / NANO
        if cap is None or duration is None or deficit <= 0 or (room := duration * cap - now) <= 0:
            return total, (speed, False, was)
        said, x = written_speed(duration / (now + min(room, deficit)))
        plays = duration / x if x > 0 else 0.0
        return total + round((plays - was) * NANO), (said, True, plays)

    reads = ["speed", "s_duration_sec", "cap", "p_now", "p_was", "p_least"]
    adds = {"p_speed": pa.string(), "p_slowed": pa.bool_(), "p_played": pa.float64()}
    whole = F.round(F.greatest(F.col("s_duration_sec") * F.col("cap") - F.col("p_now"), F.lit(0.0)) * NANO)
    done = scanned(rows, ["project_id"], "p_place", F.round(F.col("p_total") * NANO), whole, reads, step, adds, run)
    notes = F.when(F.col("p_slowed"), F.concat("notes", F.lit(" [自动延展: 慢放以补足时长]"))).otherwise(F.col("notes"))
    return done.withColumn("notes", notes).withColumn("speed", F.col("p_speed")).select(*decisions.columns, "p_played")


def extend_slow(decisions: DataFrame, shots: DataFrame, least: DataFrame, min_fps: float = 60.0, run: int = RUN) -> DataFrame:
    """In order, shots are slowed up to their caps until the project lasts ``least`` (project_id, target_min).

    The written speed is rounded and what it plays feeds the next step. Decisions
    are told apart by their place, so a shot that is used twice is slowed twice.
    """
    rows = decisions.join(least.select("project_id", F.col("target_min").alias("p_lo")), "project_id")
    return _slowed(rows, shots, F.col("p_lo"), min_fps, run).select(decisions.columns)


def _in_reach(rows: DataFrame) -> DataFrame:
    """Of supplements with total_sec, target_min, target_max those of the beats that the walk may reach.

    While a project is short of target_min, every shot no longer than the band is used, and once it
    is not, no shot is. So the total before a beat is at least the start plus such
    shots of the beats before it, and after a beat where that meets target_min all later ones
    are left alone. Rounded so that doubt keeps a beat. The beats that stay are the first of their project.
    """
    place = _narrative()
    length = F.col("duration_sec") * NANO
    sure = F.ceil(length) <= F.floor(F.col("target_max") * NANO) - F.ceil(F.col("target_min") * NANO)
    short = F.ceil(F.col("target_min") * NANO) - F.floor(F.col("total_sec") * NANO)
    beats = rows.groupBy("project_id", "act", "beat").agg(F.sum(F.when(sure, F.floor(length)).otherwise(0)).alias("_adds"), F.max(short).alias("_short")).withColumns(place)
    # frames by value: names of one place stay or go together
    upto, own = Window.partitionBy("project_id").orderBy(*place), Window.partitionBy("project_id", *place)
    beats = beats.withColumn("_before", F.sum("_adds").over(upto) - F.sum("_adds").over(own)).withColumn("_most", F.max("_before").over(upto))
    first = staged(beats.where("_most < _short").select(*[F.col(c).alias(f"_{c}") for c in ("project_id", "act", "beat")]))
    same = (F.col("project_id") == F.col("_project_id")) & F.col("act").eqNullSafe(F.col("_act")) & F.col("beat").eqNullSafe(F.col("_beat"))
    return rows.join(few(first), same, "left_semi")


def _supplements(decisions: DataFrame, totals: DataFrame, supplements: DataFrame, run: int = RUN) -> DataFrame:
    """The new decisions; ``totals`` has project_id, total_sec, target_min, target_max. Guessed: all are used."""
    unused = supplements.join(decisions.select("project_id", "shot_id"), ["project_id", "shot_id"], "left_anti")
    rows = unused.select("project_id", "shot_id", "source_file", "tc_in", "tc_out", "duration_sec", "act", "beat").join(staged(totals), "project_id")
    rows = narrative_order(_in_reach(rows)).drop("act", "beat", "act_no", "scene_no")

    def step(total, duration, least, most):
        added = None if duration is None else round(duration * NANO)
        use = added is not None and total < round(least * NANO) and total + added <= round(most * NANO)
        return (total + added if use else total), (use,)

    length, start = F.round(F.col("duration_sec") * NANO), F.round(F.col("total_sec") * NANO)
    used = scanned(staged(rows), ["project_id"], "narrative_no", start, length, ["duration_sec", "target_min", "target_max"], step, {"used": pa.bool_()}, run)
    return used.where("used").select(
        "project_id", F.lit(0).alias("seq"), "shot_id", "source_file", "tc_in", "tc_out", F.lit("1x").alias("speed"), F.lit("补充插入").alias("technique"),
        F.lit("硬切").alias("transition"), F.lit("保留原声").alias("audio"), F.lit("补充时长 / 缺失情节点").alias("purpose"), F.lit("由时长不足自动从备选池补充").alias("notes"),
    )


def extend_supplement(decisions: DataFrame, shots: DataFrame, supplements: DataFrame, targets: DataFrame, run: int = RUN) -> DataFrame:
    """Supplements in narrative order that are not used yet and fit under target_max, until target_min is met.

    ``targets`` has project_id, target_min, target_max. New decisions have seq 0.
    """
    totals = targets.join(projected_duration(decisions, shots), "project_id", "left").select("project_id", F.coalesce("total_sec", F.lit(0.0)).alias("total_sec"), "target_min", "target_max")
    new = _supplements(decisions, totals, supplements, run)
    return decisions.select(new.columns).unionByName(new)


def targets(projects: DataFrame, text: str = "target") -> DataFrame:
    """E5: target seconds and the band of five percent around it; a target of 0 asks for nothing."""
    t = parse_duration(F.col(text))
    return projects.select("project_id", t.alias("target_sec"), (t * 0.95).alias("target_min"), (t * 1.05).alias("target_max"))


def fit_duration(decisions: DataFrame, shots: DataFrame, supplements: DataFrame, budget: DataFrame, min_fps: float = 60.0) -> DataFrame:
    """Projects over the band are compressed, under it extended, the others left alone.

    Whether to act is judged by time codes at 24 frames, the steps by the shots'
    seconds. A project without decisions is extended from nothing. Decisions and their shots
    are staged, as each step reads them; shots without a decision are in no step.
    """
    decisions = staged(decisions)
    shots = shots.select("project_id", "shot_id", "duration_sec", "fps", "state", "status", "quality_score", "tags", "camera_movement")
    shots = staged(shots.join(decisions.select("project_id", "shot_id"), ["project_id", "shot_id"], "left_semi"))
    band = budget.select("project_id", "target_sec", "target_min", "target_max").join(projected_duration(decisions), "project_id", "left")
    total = F.coalesce("total_sec", F.lit(0.0))
    acts = F.when(F.col("target_sec") <= 0, "none").when(total > F.col("target_max"), "compress").when(total < F.col("target_min"), "extend").otherwise("none")
    band = band.select("project_id", F.col("target_min").alias("p_lo"), F.col("target_max").alias("p_hi"), acts.alias("p_mode"))
    marked = staged(decisions.join(band, "project_id", "left"))
    of_mode = lambda m: marked.where(F.coalesce("p_mode", F.lit("none")) == m)
    shorter = compress_drop(compress_speed(of_mode("compress"), shots), shots, F.col("p_hi"))
    slower = staged(_slowed(of_mode("extend"), shots, F.col("p_lo"), min_fps))
    lengths = slower.groupBy("project_id").agg(F.round(F.sum("p_played"), 6).alias("total_sec"))
    wanted = band.where("p_mode = 'extend'").join(lengths, "project_id", "left")
    totals = wanted.select("project_id", F.coalesce("total_sec", F.lit(0.0)).alias("total_sec"), F.col("p_lo").alias("target_min"), F.col("p_hi").alias("target_max"))
    new = _supplements(decisions, totals, supplements)
    out = of_mode("none").select(new.columns)
    for more in (shorter, slower, new):
        out = out.unionByName(more.select(new.columns))
    return out


def final_order(decisions: DataFrame) -> DataFrame:
    """Own sequence first, supplements last by shot id, renumbered from 1."""
    late = F.col("seq") == 0
    buckets = {"_late": late, "_block": F.floor(F.col("seq") / 1000), "_name": F.when(late, F.substring("shot_id", 1, 4)).otherwise("")}
    return numbered(staged(decisions), "sequence", ["project_id"], buckets, ["seq", "shot_id"])


def warnings_text(warnings: DataFrame) -> DataFrame:
    """A text of numbered axis warnings per project."""
    line = F.concat(F.col("beat"), F.lit(": "), F.col("shot_a"), F.lit(" / "), F.col("shot_b"), F.lit(" ("), F.col("characters"), F.lit(")"))
    return warnings.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("warnings"))


def request_batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Batch number of each row in the project, ordered by a number or text column."""
    block = F.floor(F.col(order) / 1000) if isinstance(rows.schema[order].dataType, NumericType) else F.substring(order, 1, 3)
    return numbered(rows, "batch", ["project_id"], {"_block": block}, [order]).withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("int"))
