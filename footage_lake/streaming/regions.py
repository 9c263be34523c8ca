"""Activity regions of a live score stream, as session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_regions(scores: DataFrame, floor: float, gap: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """Sessions of points at or above ``floor`` per project and asset, closed by the watermark.

    ``scores`` is a stream (or a table) with project_id, asset_id, at (timestamp) and
    cut_score. The floor is given, since an asset's own baseline is known only at its
    end. State is one open session per active asset.
    """
    high = scores.withWatermark("at", late).where(F.col("cut_score") >= floor)
    sessions = high.groupBy("project_id", "asset_id", F.session_window("at", gap).alias("span")).agg(
        F.count("*").alias("n_points"), F.max("cut_score").alias("peak"), F.max("at").alias("last")
    )
    return sessions.select("project_id", "asset_id", F.col("span.start").alias("start"), F.col("last").alias("end"), "n_points", "peak")
