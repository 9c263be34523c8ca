"""The lexical matcher shot by shot, against the join on tokens."""

import random

import pytest
from pyspark.sql import functions as F

from footage_lake.operators import anchors


@pytest.mark.parametrize("weights", [None, {"action": 1.0}])
def test_shots_count_their_own_tokens(spark, weights):
    """Words that are shared by many, equal scores, empty fields, a project without beats."""
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(["夜", "w"]) + str(rng.randint(0, 30)) for _ in range(n)) if n else None
    fields = "location string, action string, emotion string, dialogue string"
    shots = spark.createDataFrame([(rng.choice("pqr"), f"S{k}", *[said(rng.randint(0, 5)) for _ in range(4)]) for k in range(300)] + [(None, "S900", "w1", "w1", "", "")], f"project_id string, shot_id string, {fields}")
    beats = spark.createDataFrame([(rng.choice("pq"), k, *[said(rng.randint(0, 6)) for _ in range(4)]) for k in range(60)], f"project_id string, beat_id int, {fields}").withColumn("beat_id", F.format_string("b%02d", "beat_id"))
    got, want = (sorted(map(tuple, anchors.anchor_lexical(shots, beats, weights, most=n).collect()), key=str) for n in (10**6, 0))
    assert got == want and len({r[2] for r in got}) > 20


def test_a_shot_makes_no_row_for_each_beat(spark):
    beats = spark.range(400).select(F.lit("p").alias("project_id"), F.format_string("b%03d", "id").alias("beat_id"), F.concat(F.lit("walk w"), F.col("id").cast("string")).alias("action"))
    shots = spark.range(50).select(F.lit("p").alias("project_id"), F.col("id").alias("shot_id"), F.concat(F.lit("walk w"), F.col("id").cast("string")).alias("action"))
    held = anchors._tokens(beats, ["project_id", "beat_id"], ["action"]).collect()
    assert anchors._scored(shots, held, beats.schema["beat_id"].dataType, {"action": 1.0}).count() == 50
