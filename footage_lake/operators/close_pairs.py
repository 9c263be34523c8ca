"""Pairs of close rows within groups, without a task or a join that holds all pairs of a group.

A group's rows are dealt into parts. A part's own rows are held as one array; the group's
other rows stream past them in batches, and the test runs on arrays. A pair is found where
its earlier row is the part's own, so once.

Unit vectors of large groups are first dealt to cells around pivots. A vector's home is
the cell of the pivot that it is nearest to. If two vectors of different homes have a
cosine of c or more, each lies within sqrt(1 - c^2) of the hyperplane between the two
pivots, as no point of the sphere beyond that plane is nearer. So a vector is a guest in
those cells to whose plane it is as near, and in no other: the join stays exact, and what
it saves is measured by ``cell_figures``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from footage_lake.functions.ordered import few

#: Rows that a part owns, about.
PART = 16_384
#: Rows of a group from which its vectors are dealt to cells; pivots at most.
CELL, PIVOTS = 16_384, 512
_ROWS, _COLUMNS = 512, 2048
#: Pairs of numbers that are compared at once.
_CACHED = 1 << 16
_NIBBLES = np.uint64(0x1111111111111111)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _digits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hex digits in which 64-bit numbers differ."""
    x = a[:, None] ^ b[None, :]
    return np.bitwise_count((x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & _NIBBLES)


class Measure:
    """What is compared and when it is close: ``kind`` is cosine (at least ``bound``), bits or digits (at most ``bound``)."""

    def __init__(self, kind: str, bound: float) -> None:
        self.kind, self.bound = kind, bound

    def values(self, column: pa.Array) -> np.ndarray:
        """A row of doubles per vector, or the 64-bit numbers."""
        if self.kind != "cosine":
            return column.to_numpy(zero_copy_only=False).view(np.uint64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a, row of b, value) of the close pairs, in order."""
        if self.kind != "cosine":
            return self._near(a, b)
        value = a @ b.T
        x, y = np.nonzero(value >= self.bound)
        return x, y, value[x, y].astype(float)

    def _near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers are compared in tiles that stay in a core's cache."""
        told, found = _bits if self.kind == "bits" else _digits, []
        width = max(_CACHED // max(len(a), 1), 64)
        for at in range(0, len(b), width):
            value = told(a, b[at : at + width])
            close = value <= self.bound
            if close.any():
                x, y = np.nonzero(close)
                found.append((x, y + at, value[x, y].astype(float)))
        if len(found) < 2:
            return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        x, y, value = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(x, kind="stable")
        return x[order], y[order], value[order]


class _Part:
    """The own rows of one part, complete once another row of the part has come."""

    def __init__(self, place: int) -> None:
        self.place, self.rows, self.held = place, [], None
        self.groups: dict[tuple, int] = {}

    def coded(self, project: pa.Array, beat: pa.Array) -> np.ndarray:
        """A number for each row's group; a part has one group, unless places collide."""
        pairs = zip(project.to_pylist(), beat.to_pylist(), strict=True)
        return np.array([self.groups.setdefault(g, len(self.groups)) for g in pairs], np.int32)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(groups, numbers, values), joined once."""
        if self.held is None:
            self.held = tuple(np.concatenate([r[k] for r in self.rows]) for k in range(3))
            self.rows = [self.held]
        return self.held


def _found(batches: Iterator[pa.RecordBatch], measure: Measure, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (place, own, project_id, beat, idx, value) sorted by place, own rows first, in; (project_id, beat, i, j, value) out.

    The pairs of a tile of ``_ROWS`` by ``_COLUMNS`` rows are told before the next tile, so
    however many are close, a task holds those of one tile.
    """
    part: _Part | None = None

    def meet(a: tuple, b: tuple) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a[1]), _ROWS):
            for to in range(0, len(b[1]), _COLUMNS):
                x, y, v = measure.close(a[2][at : at + _ROWS], b[2][to : to + _COLUMNS])
                x, y = x + at, y + to
                once = (a[1][x] < b[1][y]) & (a[0][x] == b[0][y])
                if once.any():
                    x, y, v = x[once], y[once], v[once]
                    of, names = pa.array(a[0][x]), list(part.groups)
                    said = [pa.array([g[k] for g in names], kinds[k]).take(of) for k in range(2)]
                    yield pa.RecordBatch.from_arrays([*said, pa.array(a[1][x], kinds[2]), pa.array(b[1][y], kinds[3]), pa.array(v, kinds[4])], ["project_id", "beat", "i", "j", "value"])

    for batch in batches:
        place, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(own.astype(np.int8)) != 0)) + 1
        for at, to in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if part is None or part.place != place[at]:
                if part is not None and part.rows:
                    yield from meet(part.own(), part.own())
                part = _Part(int(place[at]))
            if not own[at] and not part.rows:
                continue
            piece = batch.slice(at, to - at)
            rows = part.coded(piece.column(2), piece.column(3)), piece.column(4).to_numpy(), measure.values(piece.column(5))
            if own[at]:
                part.rows.append(rows)
            else:
                yield from meet(part.own(), rows)
    if part is not None and part.rows:
        yield from meet(part.own(), part.own())


def pivots_of(rows: DataFrame, n: int) -> np.ndarray:
    """Up to ``n`` distinct vectors in the order of a hash, thinned by it before they are ordered."""
    total = max(rows.count(), 1)
    share = min(1.0, 4 * max(n, 64) / total)
    h = F.xxhash64(F.lit("pivot"), "value")
    some = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select("value", h.alias("h")).dropDuplicates(["h"]).orderBy("h").limit(n)
    return np.array([r["value"] for r in some.collect()])


def cells_of(x: np.ndarray, pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for the home of each unit vector and the cells in which it is a guest, at cosine ``least``."""
    near = x @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-24))
    margin = (near[np.arange(len(x)), home][:, None] - near) / apart[home]
    row, cell = np.nonzero(margin <= (math.sqrt(max(0.0, 1 - least * least)) + 1e-9 if least > 0 else math.inf))
    return row, cell, cell == home[row]


def celled(rows: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """Rows with a unit vector ``value``, a row for each cell of theirs, with ``cell`` and ``home``."""
    sent, names = rows.sparkSession.sparkContext.broadcast(pivots), [*rows.columns, "cell", "home"]

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(at, _ROWS)
                vectors = piece.column(piece.schema.get_field_index("value"))
                row, cell, home = cells_of(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), sent.value, least)
                taken = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(home)], names)

    return rows.mapInArrow(of_batch, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("home", BooleanType())]))


def _cells(rows: DataFrame, sizes: DataFrame, least: float, cell: int, most: int) -> DataFrame:
    """Rows with cell and home: large groups of each dimension by pivots, the others in one cell."""
    marked = rows.join(few(sizes), ["project_id", "beat", "dims"])
    out = marked.where(F.col("n") <= cell).drop("n").withColumns({"cell": F.lit(0), "home": F.lit(True)})
    for r in sizes.where(F.col("n") > cell).groupBy("dims").agg(F.max("n").alias("n")).collect():
        large = marked.where((F.col("n") > cell) & (F.col("dims") == r["dims"])).drop("n")
        out = out.unionByName(celled(large, pivots_of(large, min(most, math.ceil(r["n"] / cell))), least))
    return out


def close_pairs(rows: DataFrame, measure: Measure, part: int = PART, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """(project_id, beat, i, j, value) of the close pairs of rows (project_id, beat, idx, value) of a project's beat, i < j.

    ``value`` is a unit vector (array of doubles) for a cosine, else a bigint. Only
    vectors of one length are compared. Numbers ``idx`` are distinct in a beat.
    """
    cosine = measure.kind == "cosine"
    rows = rows.select("project_id", "beat", F.col("idx").cast("bigint").alias("idx"), "value").where("value IS NOT NULL AND idx IS NOT NULL AND project_id IS NOT NULL AND beat IS NOT NULL")
    rows = rows.withColumn("dims", F.size("value") if cosine else F.lit(1)).where("dims > 0")
    if cosine:
        sizes = rows.groupBy("project_id", "beat", "dims").agg(F.count("*").alias("n"))
        rows = _cells(rows, sizes, measure.bound, cell, pivots)
    else:
        rows = rows.withColumns({"cell": F.lit(0), "home": F.lit(True)})
    keys = ["project_id", "beat", "dims", "cell"]
    homes = rows.where("home").groupBy(*keys).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = rows.join(few(homes), keys).withColumn("own_part", F.when(F.col("home"), F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int")).otherwise(-1))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.col("part") == F.col("own_part"))
    placed = dealt.select(F.xxhash64(*keys, "part").alias("place"), "own", "project_id", "beat", "idx", "value").repartition("place").sortWithinPartitions("place", F.desc("own"))
    kinds = {c: rows.schema[c].dataType for c in ("project_id", "beat")}
    arrow = [*(to_arrow_type(t) for t in kinds.values()), pa.int64(), pa.int64(), pa.float64()]
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", i bigint, j bigint, value double"
    return placed.mapInArrow(lambda it: _found(it, measure, arrow), schema)


def cell_figures(vectors: np.ndarray, pivots: np.ndarray, least: float) -> dict[str, float]:
    """Cells a vector is sent to on average, and the pairs that meet as a share of all pairs."""
    row, cell, home = cells_of(vectors, pivots, least)
    homes, all_ = np.bincount(cell[home], minlength=len(pivots)), np.bincount(cell, minlength=len(pivots))
    n = len(vectors)
    return {"replication": len(row) / n, "met": float((homes * (homes - 1) / 2 + homes * (all_ - homes) / 2).sum() / (n * (n - 1) / 2))}
