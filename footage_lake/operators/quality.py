"""Quality of a shot from 0 to 10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights where none are given, and those of names that a given map leaves out.
WEIGHTS = {"script_confidence": 0.35, "visual_quality": 0.20, "stability": 0.15, "dialogue": 0.10, "duration": 0.10, "metadata_complete": 0.10}
PARTIAL = {"script_confidence": 0.20, "visual_quality": 0.25, "stability": 0.20, "dialogue": 0.15, "duration": 0.10, "metadata_complete": 0.10}
FILLED = ["shot_size", "camera_position", "camera_movement", "location", "emotion", "action"]


def normalize_1_5(value: Column) -> Column:
    """a mark of 1 to 5 as a share; missing or unreadable marks are one half."""
    v = value.cast("string").try_cast("double")
    return F.when(v.isNull(), F.lit(0.5)).when(v <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), v / 5))


def duration_score(seconds: Column) -> Column:
    """steps by length."""
    return F.when(seconds <= 0, 0.0).when(seconds < 1, 0.3).when(seconds <= 30, 1.0).when(seconds <= 60, 0.8).otherwise(0.6)


def metadata_completeness(fields: list[str] | None = None, people: str = "characters") -> Column:
    """share of seven fields that are neither null, empty nor 未知."""
    names = FILLED if fields is None else fields
    filled = [(F.coalesce(F.col(c), F.lit("")).isin("", "未知") == F.lit(False)).cast("int") for c in names]
    filled.append((F.size(F.coalesce(F.col(people), F.array().cast("array<string>"))) > 0).cast("int"))
    return sum(filled[1:], filled[0]) / F.lit(len(filled))


def quality_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the shares times 10, two places; speech adds half of its weight at most.

    Reads visual_quality, confidence, stability, asr_text, dialogue, duration_sec
    and the fields of ``metadata_completeness``.
    """
    w = {**PARTIAL, **weights} if weights else WEIGHTS
    speech = (F.length(F.coalesce("asr_text", F.lit(""))) > 0) | (F.length(F.coalesce("dialogue", F.lit(""))) > 0)
    parts = {
        "visual_quality": normalize_1_5(F.col("visual_quality")),
        "script_confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
        "stability": normalize_1_5(F.col("stability")),
        "dialogue": F.when(speech, 0.5).otherwise(0.0),
        "duration": duration_score(F.col("duration_sec")),
        "metadata_complete": metadata_completeness(),
    }
    total = None
    for name, share in parts.items():
        total = F.lit(w[name]) * share if total is None else total + F.lit(w[name]) * share
    return F.round(total * 10, 2)
