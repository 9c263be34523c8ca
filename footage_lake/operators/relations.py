"""Links between neighbouring shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTINUOUS = "同素材时间连续"


def source_links(shots: DataFrame, order: str = "tc_in") -> DataFrame:
    """Previous and next shot of the same source file, fixed type and coherence .95."""
    w = Window.partitionBy("project_id", "source_file").orderBy(order, "shot_id")
    link = lambda c: F.when(
        c.isNotNull(), F.struct(c.alias("shot_id"), F.lit(CONTINUOUS).alias("relationship_type"), F.lit(0.95).alias("coherence_score"))
    )
    return shots.withColumn("prev", link(F.lag("shot_id").over(w))).withColumn("next", link(F.lead("shot_id").over(w)))


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def classify_pair(a: Column, b: Column) -> Column:
    """Type and coherence of two neighbours given as structs of their attributes."""
    text = lambda s, f: F.coalesce(s[f], F.lit(""))
    differs = lambda f: (text(a, f) != "") & (text(b, f) != "") & (text(a, f) != text(b, f))
    pa, pb = _set(a["characters"]), _set(b["characters"])
    camera, place, mood = differs("camera_position"), differs("location"), differs("emotion")
    people = (F.size(pa) > 0) & (F.size(pb) > 0) & (pa != pb)
    ta, tb = text(a, "asr_text"), text(b, "asr_text")
    speech = (ta != "") & (tb != "") & (F.contains(tb, ta) | F.contains(ta, tb))
    cost = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    raw = F.lit(0.8) - cost(camera, 0.3) - cost(place, 0.35) - cost(mood, 0.2) - cost(people, 0.15) + cost(speech, 0.1)
    # two places suffice for the sum of the fixed steps, and hide what binary fractions add
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 6)))
    reason = camera | place | mood | people | speech
    kind = (
        F.when((score >= 0.75) & ~reason, "情绪延续")
        .when(score >= 0.75, "自然过渡")
        .when(place, "场景切换")
        .when(camera, "机位跳切")
        .when(people, "动作衔接")
        .when(mood, "情绪转折")
        .otherwise("时间跳跃")
    )
    return F.struct(kind.alias("relationship_type"), F.round(score, 2).alias("coherence_score"))


ATTRIBUTES = ["camera_position", "location", "emotion", "characters", "asr_text"]


def relations(shots: DataFrame, within_asset: bool = False, order: str = "tc_in") -> DataFrame:
    """Edge table src_shot, dst_shot, type, coherence of neighbours in the order (source file, start).

    The order runs over a project and so links the last shot of a file with the
    first of the next, unless ``within_asset``.
    """
    keys = ["project_id", "source_file"]
    w = Window.partitionBy(*keys).orderBy(order, "shot_id")
    attrs = F.struct("shot_id", *ATTRIBUTES)
    pairs = shots.select("project_id", F.lag(attrs).over(w).alias("a"), attrs.alias("b")).where("a IS NOT NULL")
    if not within_asset:
        # of each file the first and last shot; only these are ordered over the project
        at = F.struct(F.col(order), F.col("shot_id"))
        ends = shots.groupBy(*keys).agg(F.min_by(attrs, at).alias("b"), F.max_by(attrs, at).alias("last"))
        across = ends.select("project_id", F.lag("last").over(Window.partitionBy("project_id").orderBy("source_file")).alias("a"), "b")
        pairs = pairs.unionByName(across.where("a IS NOT NULL"))
    return pairs.select("project_id", F.col("a.shot_id").alias("src_shot"), F.col("b.shot_id").alias("dst_shot"), classify_pair(F.col("a"), F.col("b")).alias("r")).select(
        "project_id", "src_shot", "dst_shot", "r.*"
    )
