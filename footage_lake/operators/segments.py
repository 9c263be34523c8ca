"""Segment lookup and boundary scores.

``segments`` has project_id, asset_id, seg_seq, start_us, end_us, attributes;
``points`` has project_id, asset_id, t_us.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footage_lake.functions.spans import at_slots, slot_of

KEYS = ["project_id", "asset_id"]
ATTRIBUTES = ["camera_position", "characters", "emotion", "action", "location", "dialogue", "coherence_score", "is_long_take"]
WEIGHTS = {"camera_change": 0.35, "subject_change": 0.25, "emotion_break": 0.15, "action_break": 0.10, "plot_shift": 0.10, "dialogue_break": 0.05}


def segment_at(points: DataFrame, segments: DataFrame, shift: int, name: str) -> DataFrame:
    """B1: struct ``name`` of the first segment with start <= t + shift < end, else of the last one.

    Points and segments meet in time slots, so neither a task nor a point holds all
    segments of an asset. A segment has rows in the slots where it starts and ends; of
    those that cover a slot whole the first one is found for the slot, so segments of
    hours are not dealt to all their slots.
    Points of an asset without segments are left out, points without a time get the last one.
    """
    seg = segments.select(*KEYS, F.struct("seg_seq", "start_us", "end_us", *ATTRIBUTES).alias("_seg"))
    last = seg.groupBy(*KEYS).agg(F.max("_seg").alias("_last"))
    start, end = F.col("_seg.start_us"), F.col("_seg.end_us")
    t = F.col("t_us") + shift
    asked = points.select(*KEYS, "t_us").distinct().withColumn("_slot", slot_of(t))
    slots = at_slots(seg.where(start < end), KEYS, start, end - 1, F.col("_seg"), points=asked).withColumnRenamed("_value", "_seg")
    met = asked.join(slots, [*KEYS, "_slot"])
    hits = met.where((start <= t) & (t < end)).groupBy(*KEYS, "t_us").agg(F.min("_seg").alias("_hit"))
    found = points.join(hits, [*KEYS, "t_us"], "left").join(last, KEYS)
    return found.select(*[F.col(c) for c in points.columns], F.coalesce("_hit", "_last").alias(name))


def _people(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def boundary_score(a: Column, b: Column, weights: dict[str, float] | None = None) -> Column:
    """Struct of score (three places, floor 0) and joined reasons for the segments left and right."""
    w = {**WEIGHTS, **(weights or {})}
    text = lambda s, f: F.coalesce(s[f], F.lit(""))
    differs = lambda f: (text(a, f) != "") & (text(b, f) != "") & (text(a, f) != text(b, f))
    pa, pb = _people(a["characters"]), _people(b["characters"])
    letters = lambda s: F.array_distinct(F.array_remove(F.split(text(s, "action"), ""), ""))
    share = F.size(F.array_intersect(letters(a), letters(b))) / F.greatest(F.size(letters(a)), F.lit(1))
    arrow = lambda word, f: F.concat(F.lit(word), a[f], F.lit(" → "), b[f])
    factors = [
        ("camera_change", differs("camera_position"), arrow("机位变化: ", "camera_position")),
        (
            "subject_change",
            (F.size(pa) > 0) & (F.size(pb) > 0) & (pa != pb),
            F.concat(F.lit("主体变化: "), F.array_join(pa, ","), F.lit(" → "), F.array_join(pb, ",")),
        ),
        ("emotion_break", differs("emotion"), arrow("情绪变化: ", "emotion")),
        (
            "action_break",
            (text(a, "action") != "") & (text(b, "action") != "") & (share < 0.3),
            F.concat(F.lit("动作不连续: "), a["action"], F.lit(" vs "), b["action"]),
        ),
        ("plot_shift", differs("location"), arrow("场景变化: ", "location")),
        ("dialogue_break", differs("dialogue"), F.lit("对话/台词变化")),
    ]
    score, reasons = F.lit(0.0), []
    for name, holds, reason in factors:
        score = score + F.when(holds, F.lit(float(w[name]))).otherwise(F.lit(0.0))
        reasons.append(F.when(holds, reason))
    calm = (F.coalesce(a["coherence_score"], F.lit(0.0)) > 0.7) & (F.coalesce(b["coherence_score"], F.lit(0.0)) > 0.7)
    score = score - F.when(calm, F.lit(0.25)).otherwise(F.lit(0.0))
    reasons.append(F.when(calm, F.lit("两侧段落内部连贯性高，抑制切分")))
    return F.struct(
        F.round(F.greatest(F.lit(0.0), score), 3).alias("score"), F.array_join(F.array_compact(F.array(*reasons)), "; ").alias("reason")
    )


def confidence(score: Column) -> Column:
    """High from .55, medium from .40, else low."""
    return F.when(score >= 0.55, "high").when(score >= 0.40, "medium").otherwise("low")


def score_boundaries(candidates: DataFrame, segments: DataFrame, assets: DataFrame, weights: dict[str, float] | None = None, reach: int = 100_000) -> DataFrame:
    """Scores of candidate times strictly inside the asset whose two sides are not the same segment."""
    inner = candidates.join(assets.select(*KEYS, "duration_us"), KEYS).where((F.col("t_us") > 0) & (F.col("t_us") < F.col("duration_us")))
    sides = segment_at(segment_at(inner, segments, -reach, "left"), segments, reach, "right")
    apart = sides.where(~F.col("left").eqNullSafe(F.col("right")))
    scored = apart.withColumn("s", boundary_score(F.col("left"), F.col("right"), weights))
    return scored.select(*KEYS, "t_us", "s.score", "s.reason", confidence(F.col("s.score")).alias("confidence"))


def protect_long_takes(boundaries: DataFrame, segments: DataFrame, assets: DataFrame, least: int = 30_000_000, cost: float = 0.15) -> DataFrame:
    """``cost`` off where the cut lies in a long take: cuts around it 30 s apart, or the segment says so."""
    w = Window.partitionBy(*KEYS).orderBy("t_us")
    rows = segment_at(boundaries.join(assets.select(*KEYS, "duration_us"), KEYS), segments, 10_000, "here")
    rows = rows.withColumn("before", F.coalesce(F.lag("t_us").over(w), F.lit(0))).withColumn("after", F.coalesce(F.lead("t_us").over(w), F.col("duration_us")))
    long = (
        (F.col("after") - F.col("before") >= least)
        | F.coalesce(F.col("here.is_long_take"), F.lit(False))
        | (F.coalesce(F.col("here.coherence_score"), F.lit(0.0)) >= 0.85)
    )
    score = F.when(long, F.round(F.col("score") - cost, 3)).otherwise(F.col("score"))
    reason = F.when(long, F.concat("reason", F.lit(" [长镜头/高连贯保护]"))).otherwise(F.col("reason"))
    return rows.select(*KEYS, "t_us", score.alias("score"), reason.alias("reason"), confidence(score).alias("confidence"), long.alias("protected"))


def apply_votes(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """Candidates that a vote confirms; those without a vote stay."""
    v = votes.select(*KEYS, "t_us", "is_cut")
    return candidates.join(v, [*KEYS, "t_us"], "left").where(F.coalesce("is_cut", F.lit(True))).drop("is_cut")
