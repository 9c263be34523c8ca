"""Embedding whitening by a covariance over distinct vectors.

Equal integer vectors are grouped first, so that each is centred, multiplied and
whitened once, however often it occurs; a weight (one, or its number of rows) says what
it counts in the fit. Sums and the matrix product are added up per task and then in a
tree; what comes to the driver is a matrix of the vectors' dimensions. The rows get the
result of their vector by a join; vectors of very many rows are few, so these are sent to the
rows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footage_lake.llm.common import stored, tree_sum

#: Entries are multiplied by this and rounded down.
SCALE = 256
COMPONENTS = 4
#: Vectors of very many rows that are sent to the rows, at most.
HOT = 10_000
#: Vectors that are multiplied together.
BLOCK = 4096
_TOP = np.iinfo(np.int64).max


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) as longs; what exceeds them is the nearest one."""
    x = np.floor(values * SCALE)
    return np.where(x >= 2.0**63, _TOP, np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64))


def packed_vector(x: np.ndarray) -> bytes:
    """The least bytes for a vector of longs: one for the bytes of an entry, then the entries, little-endian, without the zeros at the end.

    Vectors that differ only by zeros at their end are the same.
    """
    for width in (1, 2, 4, 8):
        bound = 1 << 8 * width - 1
        if not len(x) or (x.min() >= -bound and x.max() < bound):
            return bytes([width]) + x.astype(f"<i{width}").tobytes().rstrip(b"\0")
    raise AssertionError("no width")


def unpacked(keys: list[bytes], dims: int | None = None) -> np.ndarray:
    """A row of longs per packed vector, all of ``dims`` entries (as many as the longest needs)."""
    widths = np.array([k[0] for k in keys], np.int64)
    sizes = np.array([len(k) - 1 for k in keys], np.int64)
    if dims is None:
        dims = int((-(-sizes // widths)).max(initial=0))
    out = np.zeros((len(keys), dims), np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        raw = b"".join(keys[k][1:].ljust(dims * width, b"\0") for k in rows.tolist())
        out[rows] = np.frombuffer(raw, f"<i{width}").reshape(len(rows), dims)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key) of the rows (vec_id, embedding) whose vector has no null or non-finite entry."""
    for b in batches:
        lists = b.column(1)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
        present = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        broken = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        rows = present[broken[offsets[present + 1]] == broken[offsets[present]]]
        with np.errstate(over="ignore", invalid="ignore"):
            x = integers(np.where(np.isfinite(flat), flat, 0.0))
        keys = [packed_vector(x[offsets[k] : offsets[k + 1]]) for k in rows.tolist()]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(keys, pa.binary())], ["vec_id", "key"])


def keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id and the packed integer vector of each row that stays."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    return embeddings.select("vec_id", vector).mapInArrow(_keyed, f"vec_id {kind}, key binary")


@dataclass
class Whitening:
    """The fit: how many vectors (by weight), their sums, and the components with their eigenvalues and V's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # a row per component
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.sums / self.n) @ self.components.T) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of (n * x - S) ^ 2, and where they fit in a long: integer sums wrap, so only the total has to fit."""
        with np.errstate(over="ignore"):
            gap = np.int64(self.n) * x - self.sums
            exact = (gap * gap).sum(axis=1)
        about = ((self.n * (x - self.sums / self.n)) ** 2).sum(axis=1)
        return exact, about < 9.2e18


def _blocks(batches: Iterator[pa.RecordBatch], dims: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and their weights (key, weight), some thousands at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield unpacked(part.column(0).to_pylist(), dims), part.column(1).to_numpy()


def fit(distinct: DataFrame, components: int = COMPONENTS, counts: bool = False) -> Whitening | None:
    """The whitening of the distinct packed vectors (key, rows), each with weight one or, if ``counts``, its rows.

    Components whose eigenvalue is not above the rounding of the largest one are left
    out, so there are fewer where the vectors vary in fewer directions. Without a vector: none.
    """
    rows = distinct.select("key", (F.col("rows") if counts else F.lit(1)).cast("long").alias("weight"))

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1, np.int64)
        for x, w in _blocks(batches, None):
            part = np.concatenate([[w.sum()], w @ x])
            long, short = (total, part) if len(total) > len(part) else (part, total)
            total = long.copy()
            total[: len(short)] += short
        return total

    total = tree_sum(rows, sums, np.int64)
    n, sums_ = int(total[0]) if len(total) else 0, total[1:]
    if not n:
        return None
    mean, dims = sums_ / n, len(sums_)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((dims, dims))
        for x, w in _blocks(batches, dims):
            centred = x - mean
            total += (centred * w[:, None]).T @ centred
        return total.ravel()

    flat = tree_sum(rows, products, np.float64)
    covariance = flat.reshape(dims, dims) / n if len(flat) else np.zeros((dims, dims))
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > dims * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)]
    chosen = vectors[:, order].T
    sign = np.array([1.0 if c[np.argmax(np.abs(c))] > 0 else -1.0 for c in chosen]).reshape(-1, 1)
    return Whitening(n, sums_, chosen * sign, values[order], float(np.trace(covariance)))


def _digest(key: bytes) -> bytes:
    """128 bits that stand for a vector in the join."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(k) for k in b.column(1).to_pylist()], pa.binary())], ["vec_id", "digest"])


def applied(distinct: DataFrame, fitted: Whitening) -> DataFrame:
    """(digest, rows, deviation, w1 ...) of each distinct vector: its whitened values, once."""
    sent = distinct.sparkSession.sparkContext.broadcast(fitted)
    k = len(fitted.values)
    names = ["digest", "rows", "deviation", *(f"w{j}" for j in range(1, k + 1))]

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                keys = part.column(0).to_pylist()
                x = unpacked(keys, len(m.sums))
                deviation, fits = m.deviations(x)
                w = m.whitened(x)
                arrays = [pa.array([_digest(v) for v in keys], pa.binary()), part.column(1), pa.array(deviation, mask=~fits), *(pa.array(w[:, j]) for j in range(k))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "digest binary, rows bigint, deviation bigint" + "".join(f", w{j} double" for j in range(1, k + 1))
    return distinct.select("key", "rows").mapInArrow(of_batch, schema)


def identity_error(white: DataFrame, k: int, counts: bool = False) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, the covariance about their own means."""
    weight = F.col("rows") if counts else F.lit(1)
    n = F.sum(weight).alias("n")
    first = white.agg(n, *(F.sum(weight * F.col(f"w{j}")).alias(f"s{j}") for j in range(1, k + 1))).first()
    gap = [F.col(f"w{j}") - F.lit(first[f"s{j}"] / first["n"]) for j in range(1, k + 1)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = white.agg(*(F.sum(weight * gap[i] * gap[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(second[f"p{i}_{j}"] / first["n"] - (i == j)) for i, j in pairs)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, counts: bool = False) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per remaining row and component.

    Rows whose vector is null or holds a null or non-finite entry go. Vectors of fewer
    entries than the longest, empty ones too, have zeros in the others. Equal vectors are
    fitted and whitened once; repeated rows come back as often as they came, null vec_ids
    too. There are ``components`` of them, or fewer where the vectors vary in fewer
    directions: one distinct vector, or none, gives no rows, nor does an empty table. A
    deviation that exceeds a long is null. Other columns are ignored, whatever their names.
    Rows and vectors are matched by a 128-bit digest.
    """
    spark = embeddings.sparkSession
    rows = keyed(embeddings)
    distinct = stored(rows.groupBy("key").agg(F.count("*").alias("rows")))
    fitted = fit(distinct, components, counts)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    k = len(fitted.values)
    white = stored(applied(distinct, fitted))
    error = identity_error(white, k, counts)
    much = max(100, white.agg(F.sum("rows")).first()[0] // HOT)
    result = ["deviation", *(f"w{j}" for j in range(1, k + 1))]
    hot = white.where(F.col("rows") > much).select(F.col("digest").alias("of"), F.lit(True).alias("sent"), *result)
    rest = white.where(F.col("rows") <= much).select(F.col("digest").alias("of"), *result)
    dealt = rows.mapInArrow(_digested, f"vec_id {kind}, digest binary")
    marked = dealt.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left")
    met = marked.where("sent").select("vec_id", *result).unionByName(
        marked.where("sent IS NULL").select("vec_id", "digest").join(rest, F.col("digest") == F.col("of")).select("vec_id", *result)
    )
    each = F.array(*(F.struct(F.lit(j).alias("component"), F.col(f"w{j}").alias("whitened"), F.lit(float(fitted.values[j - 1] / fitted.trace)).alias("explained")) for j in range(1, k + 1)))
    return met.select("vec_id", "deviation", F.explode(each).alias("c")).select(
        "vec_id", "c.component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error")
    )
