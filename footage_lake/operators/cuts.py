"""Cut detection in per-frame change scores, as windows, islands and joins.

``frame_scores`` has project_id, asset_id, t_us (microseconds, one row per time) and
cut_score. Times are integers, so RANGE frames are exact. Every step is partitioned
by project and asset; windows over the same keys share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footage_lake.functions.ordered import SPAN, gated, numbered
from footage_lake.functions.spans import containing, outside, within
from footage_lake.functions.staged import staged
from footage_lake.functions.timecode import sec_to_tc, shot_id

KEYS = ["project_id", "asset_id"]
#: Parameters of the detector in microseconds and score units.
WINDOW, CONTEXT, MERGE, GAP, LEAST_REGION, MARGIN = 100_000, 500_000, 300_000, 150_000, 600_000, 50_000
DELTA, PROMINENCE, LONG, LONG_PROMINENCE, MIN_SHOT = 0.05, 0.25, 3_500_000, 0.10, 1_000_000


def _over(*more: str):
    return Window.partitionBy(*KEYS, *more).orderBy("t_us")


def hist_change(frames: DataFrame) -> DataFrame:
    """max(0, 1 - Pearson correlation) of each frame's L1-normalised histogram with the one before."""
    total = F.aggregate("hist", F.lit(0.0).cast("double"), lambda s, x: s + F.abs(x.cast("double")))
    norm = F.transform("hist", lambda x: F.try_divide(x.cast("double"), F.col("total")))
    rows = frames.withColumn("total", total).withColumn("norm", norm)
    rows = rows.withColumn("prev", F.lag("norm").over(_over()))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    n = F.size("norm")
    rows = rows.withColumn("ma", add(F.col("prev")) / n).withColumn("mb", add(F.col("norm")) / n)
    cov = add(F.zip_with("prev", "norm", lambda a, b: (a - F.col("ma")) * (b - F.col("mb"))))
    va = add(F.transform("prev", lambda a: (a - F.col("ma")) * (a - F.col("ma"))))
    vb = add(F.transform("norm", lambda b: (b - F.col("mb")) * (b - F.col("mb"))))
    rows = rows.withColumn("hist_score", F.when(F.col("prev").isNotNull(), F.greatest(F.lit(0.0), 1 - F.try_divide(cov, F.sqrt(va * vb)))))
    return rows.select(*KEYS, "t_us", "hist_score")


def baseline(scores: DataFrame, delta: float = DELTA) -> DataFrame:
    """The score at rank floor(n / 4) of each asset, plus ``delta``."""
    w = Window.partitionBy(*KEYS)
    ranked = scores.withColumn("rn", F.row_number().over(w.orderBy("cut_score", "t_us"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rn") - 1 == F.floor(F.col("n") * 0.25)).select(*KEYS, (F.col("cut_score") + delta).alias("baseline"))


def islands(rows: DataFrame, at: str, gap: Column | int, *more: str) -> DataFrame:
    """Column ``island``: how often the step from the row before was larger than ``gap``."""
    w = Window.partitionBy(*KEYS, *more).orderBy(at)
    step = F.col(at) - F.lag(at).over(w)
    return rows.withColumn("island", F.sum(F.when(step > gap, 1).otherwise(0)).over(w))


def activity_regions(scores: DataFrame, gap: int = GAP, least: int = LEAST_REGION, delta: float = DELTA) -> DataFrame:
    """Stretches of points at or above the asset's baseline, steps up to ``gap``, ``least`` long."""
    high = scores.join(baseline(scores, delta), KEYS).where("cut_score >= baseline")
    spans = islands(high, "t_us", gap).groupBy(*KEYS, "island").agg(
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n_points"), F.max("cut_score").alias("peak")
    )
    return spans.where(F.col("end_us") - F.col("start_us") >= least).drop("island")


def outside_regions(points: DataFrame, regions: DataFrame, margin: int = MARGIN) -> DataFrame:
    """T4: points that lie in no region shrunk by ``margin`` (an anti join in time slots of the asset)."""
    return outside(points, regions, KEYS, "t_us", F.col("start_us") + margin, F.col("end_us") - margin)


def local_maxima(scores: DataFrame, window: int = WINDOW, *more: str) -> DataFrame:
    """T5: points above all before and not below all after within ``window``, which must hold three points."""
    w = _over(*more)
    before = F.max("cut_score").over(w.rangeBetween(-window, -1))
    after = F.max("cut_score").over(w.rangeBetween(1, window))
    n = F.count("*").over(w.rangeBetween(-window, window))
    marked = scores.withColumns({"before": before, "after": after, "n_near": n})
    top = F.coalesce(F.col("before") < F.col("cut_score"), F.lit(True)) & F.coalesce(F.col("after") <= F.col("cut_score"), F.lit(True))
    return marked.withColumn("is_max", top & (F.col("n_near") >= 3)).drop("before", "after", "n_near")


def prominence(scores: DataFrame, window: int = WINDOW, context: int = CONTEXT, fallback: bool = True, *more: str) -> DataFrame:
    """Score minus the mean of the points between ``window`` and ``context`` away.

    With fewer than three such points the neighbours within ``window`` serve, or,
    without ``fallback``, the prominence is null.
    """
    w = _over(*more)
    left, right = w.rangeBetween(-context, -window - 1), w.rangeBetween(window + 1, context)
    near_left, near_right = w.rangeBetween(-window, -1), w.rangeBetween(1, window)
    both = lambda f, a, b: F.coalesce(f.over(a), F.lit(0)) + F.coalesce(f.over(b), F.lit(0))
    rows = scores.withColumns(
        {
            "ctx_n": both(F.count("cut_score"), left, right),
            "ctx_sum": both(F.sum("cut_score"), left, right),
            "near_n": both(F.count("cut_score"), near_left, near_right),
            "near_sum": both(F.sum("cut_score"), near_left, near_right),
        }
    )
    near = F.when(F.col("near_n") > 0, F.col("near_sum") / F.col("near_n")).otherwise(F.lit(0.0))
    mean = F.when(F.col("ctx_n") >= 3, F.col("ctx_sum") / F.col("ctx_n"))
    if fallback:
        mean = F.coalesce(mean, near)
    return rows.withColumn("prominence", F.col("cut_score") - mean).drop("ctx_n", "ctx_sum", "near_n", "near_sum")


def merge_candidates(cuts: DataFrame, window: int = MERGE, score: str = "cut_score") -> DataFrame:
    """Of candidates chained by steps up to ``window`` the highest, ties to the earliest."""
    return (
        islands(cuts, "t_us", window)
        .groupBy(*KEYS, "island")
        .agg(F.max_by("t_us", F.struct(F.col(score), -F.col("t_us"))).alias("t_us"), F.max(score).alias(score))
        .drop("island")
    )


def hard_cuts(scores: DataFrame, regions: DataFrame | None = None, least: float = PROMINENCE) -> DataFrame:
    """Merged local maxima outside regions whose prominence is ``least`` or more."""
    regions = activity_regions(scores) if regions is None else regions
    peaks = prominence(local_maxima(scores)).where(F.col("is_max") & (F.col("prominence") >= least))
    return merge_candidates(outside_regions(peaks, regions).select(*KEYS, "t_us", "cut_score"))


def _ends(assets: DataFrame) -> DataFrame:
    """Rows t_us of 0 and the duration of each asset."""
    return assets.select(*KEYS, F.explode(F.array(F.lit(0).cast("bigint"), "duration_us")).alias("t_us"))


def _spans(points: DataFrame) -> DataFrame:
    """start_us, end_us from each point to the next of its asset."""
    spans = points.select(*KEYS, F.col("t_us").alias("start_us"), F.lead("t_us").over(_over()).alias("end_us"))
    return spans.where("end_us IS NOT NULL")


def refine_long_spans(scores: DataFrame, cuts: DataFrame, regions: DataFrame, assets: DataFrame, long: int = LONG, least: float = LONG_PROMINENCE) -> DataFrame:
    """The weak peak of highest prominence in each span over ``long``, added to the cuts.

    Windows are inside the span, so a point near a border counts in both spans. An
    asset without a cut gets none here. All cuts are then chained again and the
    earliest of each chain stays.
    """
    cuts = cuts.select(*KEYS, "t_us")
    ends = _ends(assets.join(cuts.select(*KEYS).distinct(), KEYS, "left_semi"))
    spans = _spans(cuts.unionByName(ends).distinct()).where(F.col("end_us") - F.col("start_us") > long)
    s = spans.select(*KEYS, F.col("start_us").alias("span"), (F.col("start_us") - MARGIN).alias("low"), (F.col("end_us") + MARGIN).alias("high"))
    points = within(scores.select(*KEYS, "t_us", "cut_score"), s, KEYS, "t_us", "low", "high", ["span"])
    peaks = prominence(local_maxima(points, WINDOW, "span"), WINDOW, CONTEXT, False, "span")
    peaks = outside_regions(peaks.where(F.col("is_max") & (F.col("prominence") >= least)), regions)
    free = outside(peaks, cuts, KEYS, "t_us", F.col("t_us") - MERGE, F.col("t_us") + MERGE)
    best = free.groupBy(*KEYS, "span").agg(F.max_by("t_us", F.struct("prominence", -F.col("t_us"))).alias("t_us")).drop("span")
    every = cuts.unionByName(best).distinct().withColumn("zero", F.lit(0.0))
    return merge_candidates(every, MERGE, "zero").select(*KEYS, "t_us")


def refined_cuts(scores: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, activity regions) of the scores. Regions and hard cuts are staged, as the steps read them several times; so should be ``scores``."""
    regions = staged(activity_regions(scores))
    hard = staged(hard_cuts(scores, regions).select(*KEYS, "t_us"))
    return refine_long_spans(scores, hard, regions, assets), regions


def kept_times(times: Column, least: int = MIN_SHOT, tail: bool = True) -> Column:
    """Fold over sorted times: a time stays if it is ``least`` after the last that stayed; the last always does.

    With ``tail`` a last span shorter than ``least`` loses the inner cut before it. For an
    array at hand; ``kept_cuts`` takes rows.
    """
    inner = F.slice(times, 2, F.greatest(F.size(times) - 2, F.lit(0)))
    first, last = F.get(times, F.lit(0)), F.element_at(times, -1)
    kept = F.aggregate(
        inner, F.array(first), lambda acc, t: F.when(t - F.element_at(acc, -1) >= least, F.array_append(acc, t)).otherwise(acc)
    )
    if tail:
        short = (F.size(kept) > 1) & (last - F.element_at(kept, -1) < least)
        kept = F.when(short, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
    return F.when(F.size(times) < 2, times).otherwise(F.array_append(kept, last))


def kept_cuts(cuts: DataFrame, assets: DataFrame, least: int = MIN_SHOT, tail: bool = True, span: int = SPAN) -> DataFrame:
    """Rows t_us of 0, the cuts that stay and the duration of each asset that has a length.

    The rule is that of ``kept_times``. The cuts of an asset are walked in blocks of time,
    each from all the cuts that may be its first to stay (``ordered.gated``); no array or
    task holds an asset, and the number of passes is fixed. A cut less than ``least`` before
    the end never decides on another one, so with ``tail`` all of them go first.
    """
    whole = assets.where("duration_us > 0").select(*KEYS, "duration_us")
    inner = cuts.select(*KEYS, "t_us").distinct().join(whole, KEYS).where((F.col("t_us") > 0) & (F.col("t_us") < F.col("duration_us")))
    if tail:
        inner = inner.where(F.col("duration_us") - F.col("t_us") >= least)
    # the walk reads the cuts twice, so they are found once
    walked = gated(staged(inner.drop("duration_us")), KEYS, "t_us", "t_us", least, 0, "stays", span)
    return walked.where("stays").select(*KEYS, "t_us").unionByName(_ends(whole))


def cut_times(cuts: DataFrame, assets: DataFrame, least: int = MIN_SHOT, tail: bool = True) -> DataFrame:
    """The times of ``kept_cuts`` as one sorted array ``times`` per asset."""
    found = kept_cuts(cuts, assets, least, tail).groupBy(*KEYS).agg(F.sort_array(F.collect_list("t_us")).alias("times"))
    return assets.select(*KEYS, "duration_us").join(found, KEYS)


def merge_short(times: Column, least: int = MIN_SHOT) -> Column:
    """The fold of ``kept_times`` without the rule for the tail."""
    return kept_times(times, least, tail=False)


def shots_from_cuts(points: DataFrame, fps: float = 24.0) -> DataFrame:
    """A row per span between times of ``kept_cuts`` with its number in the asset, a shot id in the project, time codes and seconds."""
    spans = _spans(points).withColumn("seq", F.row_number().over(Window.partitionBy(*KEYS).orderBy("start_us")) - 1)
    spans = numbered(spans, "number", ["project_id"], {"_asset": F.col("asset_id")}, ["start_us"])
    rate = lambda c: sec_to_tc(F.col(c) / 1e6, fps)
    return spans.select(
        *KEYS,
        "seq",
        shot_id(F.col("number")).alias("shot_id"),
        "start_us",
        "end_us",
        rate("start_us").alias("tc_in"),
        rate("end_us").alias("tc_out"),
        F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("duration_sec"),
    )


def attach_transitions(shots: DataFrame, regions: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Array ``soft_transitions`` of the regions that lie in the shot, give or take ``margin``."""
    shots = staged(shots)
    met = containing(shots.select(*KEYS, "shot_id", "start_us", "end_us"), regions, KEYS, F.col("start_us") - margin, F.col("end_us") + margin, "start_us", "end_us")
    found = met.groupBy("project_id", "shot_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_start").alias("start_us"), F.col("_end").alias("end_us")))).alias("soft_transitions")
    )
    empty = F.array().cast("array<struct<start_us:bigint,end_us:bigint>>")
    return shots.join(found, ["project_id", "shot_id"], "left").withColumn("soft_transitions", F.coalesce("soft_transitions", empty))


def whole_asset_fallback(assets: DataFrame, scores: DataFrame) -> DataFrame:
    """One span over each asset without scores; assets without a length are left out."""
    bare = assets.where("duration_us > 0").join(scores.select(*KEYS).distinct(), KEYS, "left_anti")
    return bare.select(*KEYS, "duration_us", F.array(F.lit(0).cast("bigint"), "duration_us").alias("times"))


def detect_shots(scores: DataFrame, assets: DataFrame) -> DataFrame:
    """Shots with soft transitions for every asset that has a length."""
    scores, assets = staged(scores.select(*KEYS, "t_us", "cut_score")), staged(assets)
    cuts, regions = refined_cuts(scores, assets)
    # an asset without scores has no cut, so its times are those of whole_asset_fallback
    return attach_transitions(shots_from_cuts(staged(kept_cuts(cuts, assets))), regions)


def scene_peaks(scores: DataFrame, threshold: float = 0.1, window: int = MERGE) -> DataFrame:
    """Points at or above ``threshold``, of each chain the highest."""
    return merge_candidates(scores.where(F.col("cut_score") >= threshold), window)


def classify_cuts(scores: DataFrame, reach: int = 200_000, quiet: float = 0.15) -> DataFrame:
    """``hard_cut`` where no point within ``reach`` on either side reaches ``quiet``, else ``ambiguous``."""
    side = lambda low, high: F.coalesce(F.max("cut_score").over(_over().rangeBetween(low, high)), F.lit(0.0))
    calm = (side(-reach, -1) < quiet) & (side(1, reach) < quiet)
    return scores.withColumn("cut_class", F.when(calm, "hard_cut").otherwise("ambiguous"))


def visual_quality(sharpness: Column) -> Column:
    """Sharpness / 100 within 1 to 5, two places."""
    return F.round(F.least(F.greatest(sharpness / 100, F.lit(1.0)), F.lit(5.0)), 2)


def keyframe_plan(shots: DataFrame, every: float | None = None) -> DataFrame:
    """Times at 10, 50 and 90 % of each shot, or every ``every`` seconds from its start (its middle if none fits)."""
    d = F.col("duration_sec")
    if every is None:
        at = F.array(*[F.round(d * p, 3) for p in (0.1, 0.5, 0.9)])
    else:
        n = F.floor(d / every).cast("int")
        at = F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(k * every, 3))).otherwise(F.array(F.round(d * 0.5, 3)))
    return shots.select(*KEYS, "shot_id", F.posexplode(at).alias("frame_seq", "at_sec"))


def frame_plan(assets: DataFrame, rate: float = 1.0, most: int = 60) -> DataFrame:
    """Sampling times in [0, duration): ``rate`` a second, or ``most`` evenly spaced if those are fewer."""
    d = F.col("duration_us") / 1e6
    n = F.floor(d * rate).cast("int")
    dense = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.round(k / F.lit(rate), 3))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.round(k * d / most, 3))
    times = F.array_distinct(F.filter(F.when(n <= most, dense).otherwise(even), lambda t: t < d))
    return assets.where("duration_us > 0").select(*KEYS, F.posexplode(F.sort_array(times)).alias("frame_seq", "at_sec"))


def frame_index_plan(frames: DataFrame) -> DataFrame:
    """First, middle and last frame number of each clip."""
    n = F.col("n_frames")
    at = F.array_distinct(F.array(F.lit(0).cast("bigint"), F.floor(n / 2), F.greatest(n - 1, F.lit(0)).cast("bigint")))
    return frames.where(n > 0).select(*KEYS, F.explode(at).alias("frame_idx"))


def asset_summary(shots: DataFrame) -> DataFrame:
    """A1: first time code, ordered shot ids and summed seconds per asset."""
    return shots.groupBy(*KEYS).agg(
        F.min_by("tc_in", "seq").alias("first_tc"),
        F.count("*").alias("n_shots"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "shot_id"))), lambda x: x["shot_id"]), ",").alias("shot_ids"),
        F.round(F.sum("duration_sec"), 3).alias("total_sec"),
    )
