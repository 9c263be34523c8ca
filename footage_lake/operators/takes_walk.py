"""The greedy choice among close takes, without a table of their pairs.

The walk of ``dedup.resolve_greedy`` needs a pair only while both of its rows are left. So
the rows of a group are cut into blocks in their order. A block's rows are held as arrays;
the rows of earlier blocks that are still left pass over them in order, then the block's
own. What is removed is never compared again, so a group of copies costs its rows times the
few that are left of it, and no pair is written or shuffled.

Which rows of earlier blocks pass is a guess at first: none. Then it is what the last round
left. A block is walked again only if the rows that pass over it have changed, and when none
has, all guesses hold, and the result is that of one walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footage_lake.functions.ordered import few, numbered
from footage_lake.functions.staged import staged
from footage_lake.operators.close_pairs import Measure

#: Rows of a block.
BLOCK = 32_768
_TILE = 128
_KEYS = ["project_id", "beat", "dims"]
_READ = ["idx", "shot_id", "value", "quality_score", "source_file", "source_path", "characters", "sign", "prev_to", "next_to"]
_TOLD = "project_id string, beat string, dims int, chunk bigint, idx bigint, shot_id string, kept_shot string"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]


class _Rows:
    """Rows of a batch (the columns ``_READ``) as arrays; names become the numbers that ``codes`` gives them."""

    def __init__(self, batch: pa.RecordBatch, measure: Measure, codes: dict) -> None:
        c = dict(zip(_READ, batch.columns, strict=True))
        said = lambda n: c[n].to_pylist()
        coded = lambda kind, names: np.array([-1 if x is None else codes.setdefault((kind, x), len(codes)) for x in names], np.int64)
        self.idx, self.names, self.value = c["idx"].to_numpy(), said("shot_id"), measure.values(c["value"])
        self.quality = c["quality_score"].to_numpy(zero_copy_only=False).astype(float)
        self.sign = c["sign"].to_numpy()
        self.shot, self.prev, self.next = coded("shot", self.names), coded("shot", said("prev_to")), coded("shot", said("next_to"))
        self.file = coded("file", zip(said("source_file"), said("source_path"), strict=True))
        self.characters = [tuple({codes.setdefault(("who", x), len(codes)) for x in xs or () if x is not None}) for xs in said("characters")]


class _Block:
    """The own rows of a block, in order, and which of them are left."""

    def __init__(self, key: tuple, measure: Measure, related: bool) -> None:
        self.key, self.measure, self.check = key, measure, related
        self.codes: dict = {}
        self.batches: list[pa.RecordBatch] = []
        self.rows: _Rows | None = None
        self.told: list[tuple] = []

    def close_up(self) -> None:
        """Own rows are complete."""
        if self.rows is None and self.batches:
            table = pa.Table.from_batches(self.batches).combine_chunks()
            self.rows, self.batches = _Rows(table.to_batches()[0], self.measure, self.codes), []
            self.left = np.ones(len(self.rows.idx), bool)
            self.held, self.values = np.arange(len(self.left)), self.rows.value
            self.seen: dict[tuple, np.ndarray] = {}
            places: dict[int, list[int]] = {}
            for k, who in enumerate(self.rows.characters):
                for w in who:
                    places.setdefault(w, []).append(k)
            self.places = {w: np.array(p) for w, p in places.items()}

    def _sharing(self, who: tuple) -> np.ndarray:
        if who not in self.seen:
            if len(self.seen) > 64:
                self.seen.clear()
            mask = np.zeros(len(self.left), bool)
            for w in who:
                mask[self.places.get(w, [])] = True
            self.seen[who] = mask
        return self.seen[who]

    def _related(self, a: _Rows, k: int, at: np.ndarray) -> np.ndarray:
        """``dedup.are_related`` of row ``k`` of ``a``, the earlier one, and the own rows ``at``."""
        own = self.rows
        out = (own.file[at] == a.file[k]) | (own.shot[at] == a.shot[k])
        for link in (a.prev[k], a.next[k]):
            if link >= 0:
                out |= own.shot[at] == link
        if a.sign[k] != 0 and a.characters[k]:
            against = own.sign[at] == -a.sign[k]
            if against.any():
                out |= against & self._sharing(a.characters[k])[at]
        return out

    def _told(self, rows: _Rows, k: int, kept: str) -> None:
        self.told.append((*self.key, int(rows.idx[k]), rows.names[k], kept))

    def _meet(self, a: _Rows, ks: np.ndarray, own: bool) -> None:
        """Rows ``ks`` of ``a`` pass over the own rows in order."""
        rows = self.rows
        if np.count_nonzero(self.left[self.held]) < 0.75 * len(self.held):
            self.held = self.held[self.left[self.held]]
            self.values = rows.value[self.held]
        later = int(np.searchsorted(self.held, ks[0])) if own else 0
        x, y, _ = self.measure.close(a.value[ks], self.values[later:])
        y = y + later
        ends = np.searchsorted(x, np.arange(len(ks) + 1))
        for n in np.unique(x).tolist():
            k = int(ks[n])
            if own and not self.left[k]:
                continue
            at = self.held[y[ends[n] : ends[n + 1]]]
            at = at[self.left[at] & (at > k) if own else self.left[at]]
            if self.check and len(at):
                at = at[~self._related(a, k, at)]
            if not len(at):
                continue
            worse = a.quality[k] >= rows.quality[at]
            upto = len(at) if worse.all() else int(worse.argmin())
            for j in at[:upto].tolist():
                self._told(rows, j, a.names[k])
            self.left[at[:upto]] = False
            if upto < len(at):
                self._told(a, k, rows.names[at[upto]])
                if own:
                    self.left[k] = False

    def close_to(self, a: _Rows, own: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of rows of ``a``, which are earlier, and own rows, tile by tile."""
        rows, step = self.rows, _TILE // 4
        for start in range(0, len(a.idx), step):
            x, y, v = self.measure.close(a.value[start : start + step], rows.value)
            x += start
            keep = y > x if own else np.ones(len(x), bool)
            ends = np.searchsorted(x, np.arange(start, start + step + 1))
            if self.check:
                for n in np.unique(x).tolist():
                    part = slice(ends[n - start], ends[n - start + 1])
                    keep[part] &= ~self._related(a, n, y[part])
            if keep.any():
                i, j = a.idx[x[keep]], rows.idx[y[keep]]
                said = [pa.array([c]).take(pa.array(np.zeros(len(i), np.int8))) for c in self.key[:2]]
                yield pa.RecordBatch.from_arrays([*said, pa.array(i), pa.array(j), pa.array(v[keep])], ["project_id", "beat", "i", "j", "value"])

    def passed(self, batch: pa.RecordBatch) -> None:
        """Rows of earlier blocks, in order."""
        a = _Rows(batch, self.measure, self.codes)
        for at in range(0, len(a.idx), _TILE):
            self._meet(a, np.arange(at, min(at + _TILE, len(a.idx))), False)

    def ended(self) -> None:
        at = 0
        while self.rows is not None and at < len(self.left):
            ks = at + np.flatnonzero(self.left[at:])[:_TILE]
            if not len(ks):
                break
            self._meet(self.rows, ks, True)
            at = int(ks[-1]) + 1

    def taken(self) -> list[tuple]:
        told, self.told = self.told, []
        return told


def _blocks(batches: Iterator[pa.RecordBatch], measure: Measure, related: bool) -> Iterator[tuple[_Block, pa.RecordBatch | None]]:
    """Each block with each run of rows that pass over it, then with None at its end."""
    block: _Block | None = None
    for batch in batches:
        marks = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        edges = [0, *[k for k in range(1, len(marks)) if marks[k] != marks[k - 1]], len(marks)]
        for at, to in zip(edges, edges[1:], strict=False):
            if at == to:
                continue
            *key, own = marks[at]
            if block is None or block.key != tuple(key):
                if block is not None:
                    block.close_up()
                    yield block, None
                block = _Block(tuple(key), measure, related)
            piece = pa.RecordBatch.from_arrays(batch.slice(at, to - at).columns[5:], _READ)
            if own:
                block.batches.append(piece)
            else:
                block.close_up()
                if block.rows is not None:
                    yield block, piece
    if block is not None:
        block.close_up()
        yield block, None


def _sent(rows: DataFrame) -> DataFrame:
    return rows.select(*_KEYS, "chunk", "own", *_READ).repartition(*_KEYS, "chunk").sortWithinPartitions(*_KEYS, "chunk", F.desc("own"), "idx")


def _walked(rows: DataFrame, measure: Measure, related: bool) -> DataFrame:
    """Rows (_KEYS, chunk, own, _READ): what the walk over each chunk removes."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece in _blocks(batches, measure, related):
            block.ended() if piece is None else block.passed(piece)
            if block.told:
                yield _batch(block.taken())

    return _sent(rows).mapInArrow(of_task, _TOLD)


def _batch(told: list[tuple]) -> pa.RecordBatch:
    names = [*_KEYS, "chunk", "idx", "shot_id", "kept_shot"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), _KINDS, strict=True)], names)


def _placed(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their block, the last block of each group, and the size of the largest group."""
    rows = staged(rows.select(*_KEYS, *_READ).where("project_id IS NOT NULL AND beat IS NOT NULL AND idx IS NOT NULL AND shot_id IS NOT NULL AND value IS NOT NULL"))
    sizes = staged(rows.groupBy(*_KEYS).agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    ends = few(sizes.select(*_KEYS, F.floor((F.col("n") - 1) / block).cast("bigint").alias("last")))
    if most <= block:
        return rows.withColumn("block", F.lit(0).cast("bigint")), ends, most
    placed = numbered(rows, "place", _KEYS, {"_row": F.floor(F.col("idx") / 256)}, ["idx"])
    return staged(placed.withColumn("block", F.floor((F.col("place") - 1) / block).cast("bigint")).drop("place")), ends, most


def pairs(rows: DataFrame, measure: Measure, related: bool = True, block: int = BLOCK) -> DataFrame:
    """(project_id, beat, i, j, value) of close pairs of rows as ``losers`` takes them, told where they are found: no pair is shuffled or joined to its rows."""
    blocks, ends, _ = _placed(rows, block)
    dealt = blocks.join(ends, _KEYS).withColumn("chunk", F.explode(F.sequence("block", "last"))).withColumn("own", F.col("chunk") == F.col("block"))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_, piece in _blocks(batches, measure, related):
            if block_.rows is not None:
                yield from block_.close_to(block_.rows if piece is None else _Rows(piece, measure, block_.codes), piece is None)

    return _sent(dealt).mapInArrow(of_task, "project_id string, beat string, i bigint, j bigint, value double")


def losers(rows: DataFrame, measure: Measure, related: bool = True, block: int = BLOCK) -> DataFrame:
    """(project_id, beat, shot_id, kept_shot) of the rows that the greedy walk removes, with the one that stays.

    Rows have project_id, beat, dims (only rows of equal ``dims`` are compared), ``value``
    as ``close_pairs`` takes it, and ``_READ``: idx (distinct in a group), the strong links
    ``prev_to`` and ``next_to`` and the ``sign`` of the direction. With ``related`` the pairs
    that ``dedup.are_related`` tells are left out.
    """
    result = ["project_id", "beat", "shot_id", "kept_shot"]
    blocks, ends, most = _placed(rows, block)
    if most <= block:
        return _walked(blocks.withColumns({"chunk": F.col("block"), "own": F.lit(True)}), measure, related).select(result)
    # a row passes over the chunks after its own block up to ``upto``
    state = staged(blocks.select(*_KEYS, "idx", "block").join(ends, _KEYS).withColumn("upto", F.col("block")))
    told = staged(_walked(blocks.withColumns({"chunk": F.col("block"), "own": F.lit(True)}), measure, related))
    for _ in range(most // block + 2):
        gone = told.groupBy(*_KEYS, "idx").agg(F.min("chunk").alias("gone"))
        state = staged(state.withColumnRenamed("upto", "was").join(gone, [*_KEYS, "idx"], "left").withColumn("upto", F.coalesce("gone", "last")).drop("gone"))
        moved = F.sequence(F.least("was", "upto") + 1, F.greatest("was", "upto"))
        stale = staged(state.where("was <> upto").select(*_KEYS, F.explode(moved).alias("chunk")).distinct())
        if stale.isEmpty():
            return told.select(result)
        passing = state.select(*_KEYS, "idx", "block", F.explode(F.sequence("block", "upto")).alias("chunk")).join(few(stale), [*_KEYS, "chunk"])
        again = blocks.drop("block").join(passing, [*_KEYS, "idx"]).withColumn("own", F.col("chunk") == F.col("block"))
        told = staged(told.join(few(stale), [*_KEYS, "chunk"], "left_anti").unionByName(_walked(again, measure, related)))
        state = state.drop("was")
    raise RuntimeError("the walk over close takes did not settle")
