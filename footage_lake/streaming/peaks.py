"""Cut candidates of a live score stream: local maxima and their prominence, slot by slot of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footage_lake.operators.cuts import CONTEXT, KEYS, PROMINENCE, WINDOW

_OUT = "project_id string, asset_id string, t_us bigint, cut_score double, prominence double"
_NAMES = ["project_id", "asset_id", "t_us", "cut_score", "prominence"]
#: Length of a slot in microseconds.
SLOT = 2_000_000
#: Points that are judged at once, about.
_MOST = 1_000_000


def _over(f: np.ufunc, c: np.ndarray, low: np.ndarray, high: np.ndarray, empty: float) -> np.ndarray:
    """``f`` over c[low:high] of each pair, ``empty`` where that has no entry."""
    pairs = np.stack([low, high], axis=1).ravel()
    return np.where(low < high, f.reduceat(np.append(c, empty), pairs)[::2], empty)


def _judged(key: np.ndarray, c: np.ndarray, window: int, context: int) -> np.ndarray:
    """The prominence of each point, NaN where it is no local maximum; ``key`` rises with the time, slots lie further than the context apart."""
    far_low, near_low, own = (np.searchsorted(key, key - d) for d in (context, window, 0))
    after, near_high, far_high = (np.searchsorted(key, key + d, "right") for d in (0, window, context))
    far_low, far_high = np.minimum(far_low, near_low), np.maximum(far_high, near_high)
    top = (near_high - near_low >= 3) & ~(_over(np.fmax, c, near_low, own, np.nan) >= c) & ~(_over(np.fmax, c, after, near_high, np.nan) > c)
    mean = lambda a, b, d, e: ((_over(np.add, c, a, b, 0.0) + _over(np.add, c, d, e, 0.0)) / np.maximum(b - a + e - d, 1))
    few = near_low - far_low + far_high - near_high < 3
    around = np.where(few, mean(near_low, own, after, near_high), mean(far_low, near_low, near_high, far_high))
    return np.where(top, c - around, np.nan)


def live_peaks(scores: DataFrame, least: float = PROMINENCE, window: int = WINDOW, context: int = CONTEXT, late: str = "1 minute", slot: int = SLOT) -> DataFrame:
    """Rows (project_id, asset_id, t_us, cut_score, prominence) of local maxima whose prominence is ``least`` or more.

    ``scores`` is a stream (or a table) with project_id, asset_id, at (timestamp, one row per time) and
    cut_score; rows without a time or a score are left out. Points meet in event-time windows,
    slots of ``slot`` with ``context`` on both sides, so a point near a border is in two. A
    slot is settled once the watermark, ``late`` behind the newest point of all assets, has
    passed its window: nothing can come any more that would change it. A point settles
    ``context`` to ``context`` and ``slot`` after it. State: the points of each window that is not settled;
    no row holds an asset, and settled slots are judged many at once.
    """
    reach = max(window, context)
    # a slot's points lie within one stride, and those of two slots further than the reach apart
    stride = slot + 3 * reach + 1

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = np.cumsum(b.column("points").value_lengths().to_numpy()) // _MOST
                for first, n in zip(*np.unique(part, return_index=True, return_counts=True)[1:], strict=True):
                    yield judged(b.slice(int(first), int(n)))

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        points, lists = b.column("points").flatten(), b.column("points").value_lengths().to_numpy()
        t, c = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        row = np.repeat(np.arange(len(lists)), lists)
        since = t - b.column("since").to_numpy()[row]
        key = row * stride + since
        order = np.argsort(key, kind="stable")
        t, c, row, since, key = (x[order] for x in (t, c, row, since, key))
        with np.errstate(invalid="ignore"):
            prominence = _judged(key, c, window, context)
            found = np.flatnonzero((prominence >= least) & (since >= reach) & (since < reach + slot))
        of = pa.array(row[found])
        return pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(t[found]), pa.array(c[found]), pa.array(prominence[found])], _NAMES)

    rows = scores.withWatermark("at", late).where("at IS NOT NULL AND cut_score IS NOT NULL")
    micros = lambda n: f"{n} microseconds"
    span = F.window("at", micros(slot + 2 * reach), micros(slot), micros((slot - reach) % slot))
    slots = rows.groupBy(*KEYS, span.alias("span")).agg(F.collect_list(F.struct(F.unix_micros("at").alias("t_us"), F.col("cut_score").cast("double").alias("cut_score"))).alias("points"))
    return slots.select(*KEYS, F.unix_micros("span.start").alias("since"), "points").mapInArrow(settle, _OUT)
