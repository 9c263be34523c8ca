"""Cut detection on the small series of the fixture list."""

import pytest
from pyspark.sql import functions as F

from footage_lake.operators import cuts

SCORES = "project_id string, asset_id string, t_us bigint, cut_score double"


def series(spark, peaks, base=0.02, n=100):
    rows = [("p", "a", k * 100_000, peaks.get(k, base)) for k in range(n)]
    return spark.createDataFrame(rows, SCORES)


def assets(spark, seconds=10):
    return spark.createDataFrame([("p", "a", seconds * 1_000_000)], "project_id string, asset_id string, duration_us bigint")


def spans(spark, scores, seconds=10):
    rows = cuts.detect_shots(scores, assets(spark, seconds)).orderBy("start_us").collect()
    return [(r["start_us"] / 1e6, r["end_us"] / 1e6) for r in rows], rows


def trapezoid(first, last, high, low=0.05):
    """Rises and falls over three steps, level between."""
    return {k: low + (high - low) * min(1.0, (k - first) / 3, (last - k) / 3) for k in range(first, last + 1)}


def test_flat_is_one_span(spark):
    assert spans(spark, series(spark, {}))[0] == [(0, 10)]


def test_peak_gives_two_spans(spark):
    assert spans(spark, series(spark, {50: 0.45}))[0] == [(0, 5), (5, 10)]


def test_ramp_is_no_cut(spark):
    ramp = trapezoid(45, 55, 0.45)
    assert spans(spark, series(spark, ramp))[0] == [(0, 10)]


def test_short_span_is_merged(spark):
    assert spans(spark, series(spark, {5: 0.45, 50: 0.45}))[0] == [(0, 5), (5, 10)]


def test_soft_transition_is_attached(spark):
    soft = trapezoid(45, 65, 0.30)
    found, rows = spans(spark, series(spark, soft))
    assert found == [(0, 10)] and len(rows[0]["soft_transitions"]) >= 1


def test_sparse_context_uses_neighbours(spark):
    rows = [("p", "a", 4_800_000 + k * 100_000, 0.45 if k == 2 else 0.02) for k in range(5)]
    assert spans(spark, spark.createDataFrame(rows, SCORES))[0] == [(0, 5), (5, 10)]


def test_second_pass_finds_a_weak_peak(spark):
    assert spans(spark, series(spark, {30: 0.6, 70: 0.2}))[0] == [(0, 3), (3, 7), (7, 10)]


def test_second_pass_needs_a_first_cut(spark):
    assert spans(spark, series(spark, {70: 0.2}))[0] == [(0, 10)]


def test_equal_scores_keep_the_earliest(spark):
    top = cuts.local_maxima(series(spark, {50: 0.45, 51: 0.45})).where("is_max AND cut_score > 0.4").collect()
    assert [r["t_us"] for r in top] == [5_000_000]


def test_assets_without_scores_or_length(spark):
    a = spark.createDataFrame([("p", "x", 4_000_000), ("p", "y", 0)], "project_id string, asset_id string, duration_us bigint")
    rows = cuts.detect_shots(series(spark, {}).where("false"), a).collect()
    assert [(r["asset_id"], r["duration_sec"]) for r in rows] == [("x", 4.0)]


@pytest.mark.parametrize(
    ("times", "tail", "want"),
    [([0, 500, 2000, 2600, 10000], False, [0, 2000, 10000]), ([0, 4000, 9500, 10000], True, [0, 4000, 10000]), ([0, 10000], True, [0, 10000])],
)
def test_fold_of_times(spark, times, tail, want):
    row = spark.createDataFrame([(times,)], "t array<bigint>").select(cuts.kept_times(F.col("t"), 1000, tail).alias("t")).first()
    assert row["t"] == want


def test_partitioning_does_not_matter(spark):
    s = series(spark, {20: 0.45, 50: 0.45, 75: 0.3})
    assert spans(spark, s)[0] == spans(spark, s.repartition(7, "t_us"))[0]


def test_plans(spark):
    shots = spark.createDataFrame([("p", "a", "S001", 4.0)], "project_id string, asset_id string, shot_id string, duration_sec double")
    assert [r["at_sec"] for r in cuts.keyframe_plan(shots).collect()] == [0.4, 2.0, 3.6]
    assert [r["at_sec"] for r in cuts.keyframe_plan(shots, 1.5).collect()] == [0.0, 1.5]
    assert cuts.frame_plan(assets(spark, 100), most=10).count() == 10
    frames = spark.createDataFrame([("p", "a", 9)], "project_id string, asset_id string, n_frames bigint")
    assert [r["frame_idx"] for r in cuts.frame_index_plan(frames).collect()] == [0, 4, 8]
    assert spark.range(1).select(cuts.visual_quality(F.lit(350.0))).first()[0] == 3.5


def test_scores_are_computed_once(spark):
    """Many steps read the scores; what made them runs once for each row."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    scores = series(spark, {20: 0.45, 50: 0.45, 75: 0.3})
    found, _ = spans(spark, scores.mapInArrow(count, scores.schema))
    assert found == spans(spark, scores)[0] and len(found) > 1
    assert seen.value == 100
