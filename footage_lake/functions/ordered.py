"""Running numbers over rows that are ordered in a large group, without one task per group."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from footage_lake.functions.staged import staged

#: Rows of a side that is broadcast, at most.
FEW = 500_000


def sums_before(rows: DataFrame, keys: list[str], buckets: dict[str, Column], order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums`` the sum over the group's rows before, in the order of ``buckets``, then ``order``.

    Buckets are summed up first (partial sums before the shuffle); only their totals
    are ordered within a group, rows only within their bucket.
    """
    placed = rows.withColumns(buckets).withColumns({f"_{n}": c for n, c in sums.items()})
    by = [*keys, *buckets]
    totals = placed.groupBy(*by).agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(b).alias(f"_b_{b}") for b in by], *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    same = None
    for b in by:
        test = F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        same = test if same is None else same & test
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, same)
    out = out.withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_{n}").over(inner), F.lit(0)) for n in sums})
    return out.select(*[c for c in rows.columns if c not in sums], *sums)


def numbered(rows: DataFrame, name: str, keys: list[str], buckets: dict[str, Column], order: list) -> DataFrame:
    """Adds the row's number in its group, from 1."""
    return sums_before(rows, keys, buckets, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("int"))


def few(frame: DataFrame, most: int = FEW) -> DataFrame:
    """``frame``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def beside(rows: DataFrame, keys: list[str], place: str, values: dict[str, Column], reach: int, block: int = 10_000) -> DataFrame:
    """Adds for each of ``values`` the sum over the rows up to ``reach`` places before and after, the row itself left out.

    ``place`` numbers the rows of a group from 1. Windows run in blocks of places; the
    rows next to a border are copied to the block on its other side.
    """
    at = F.col(place) - 1
    homes = F.array_distinct(F.array(*[F.floor((at + d) / block).cast("bigint") for d in (-reach, 0, reach)]))
    dealt = rows.withColumns({f"_{n}": c for n, c in values.items()}).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(-reach, reach)
    out = dealt.withColumns({n: F.sum(f"_{n}").over(w) - F.col(f"_{n}") for n in values})
    return out.where(F.col("_block") == F.floor(at / block)).select(*[c for c in rows.columns if c not in values], *values)


#: Rows that ``scanned`` walks in one run.
RUN = 50_000
_KINDS = {pa.string(): StringType(), pa.bool_(): BooleanType(), pa.float64(): DoubleType(), pa.int64(): LongType()}


def scanned(rows: DataFrame, keys: list[str], place: str, start: Column, guess: Column, reads: list[str], step: Callable, adds: dict[str, pa.DataType], run: int = RUN) -> DataFrame:
    """Rows with the columns ``adds`` of a walk in the order of ``place`` over each group, without one task per group.

    ``place`` numbers a group's rows from 1. The state is an integer total: ``start`` at
    first (of the group's first row), then what ``step(state, *values of reads)`` gives with the
    added values. Groups are cut into blocks of ``run`` rows. Each block is walked from a
    guess of the total before it: the start plus what the blocks before it add, by the sum
    of ``guess`` (a long per row) at first, then by their own last walk. Blocks whose guess was
    wrong are walked again until all hold; the first wrong block of a group is right
    next time, so this ends, and the result is that of one walk. A last pass gives the rows.
    """
    placed = rows.withColumns({"_block": F.floor((F.col(place) - 1) / run).cast("bigint"), "_start": start.cast("bigint"), "_guess": F.coalesce(guess.cast("bigint"), F.lit(0))})
    by = [*keys, "_block"]

    def walked(from_: DataFrame, last: bool) -> DataFrame:
        """Rows with the added columns, or, unless ``last``, a row per block with what it adds."""
        data = from_.drop("_guess", "_start") if last else from_.select(*by, place, "_from", *[r for r in reads if r not in (*by, place)])
        names = [*data.columns, *adds]
        at, key_at = [data.columns.index(c) for c in ("_from", *reads)], [data.columns.index(k) for k in by]
        kinds = StructType([*data.schema.fields, *[StructField(n, _KINDS[t]) for n, t in adds.items()]])
        of_block = StructType([*[data.schema[k] for k in by], StructField("_from", LongType()), StructField("_adds", LongType())])

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, first, state = None, None, None
            for b in batches:
                out, ended = [], []
                for key, begin, *values in zip(zip(*(b.column(k).to_pylist() for k in key_at), strict=True), *(b.column(k).to_pylist() for k in at), strict=True):
                    if key != group:
                        if group is not None:
                            ended.append((*group, first, state - first))
                        group, first, state = key, begin, begin
                    state, added = step(state, *values)
                    out.append(added)
                if last:
                    yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[k] for r in out], t) for k, t in enumerate(adds.values())]], names)
                elif ended:
                    yield _batch(ended, of_block)
            if group is not None and not last:
                yield _batch([(*group, first, state - first)], of_block)

        return data.repartition(*by).sortWithinPartitions(*by, place).mapInArrow(of_task, kinds if last else of_block)

    sizes = placed.groupBy(*keys).agg(F.max("_block").alias("_last"))
    if not sizes.where("_last > 0").isEmpty():
        placed = staged(placed)
        blocks = placed.groupBy(*by).agg(F.min_by("_start", place).alias("_start"), F.sum("_guess").alias("_adds"))
        before = Window.partitionBy(*keys).orderBy("_block")
        begin = F.first("_start").over(before) + F.coalesce(F.sum("_adds").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = lambda b: b.select(*by, "_start", begin.alias("_from"))
        known = staged(starts(blocks))
        wrong, done = known, None
        while not wrong.isEmpty():
            again = walked(placed.join(few(wrong.select(*by, "_from")), by), False)
            kept = again if done is None else done.join(few(wrong.select(*by)), by, "left_anti").unionByName(again)
            done = staged(kept)
            known = staged(starts(done.join(few(known.select(*by, "_start")), by)))
            wrong = known.join(few(done.select(*by, F.col("_from").alias("_was"))), by).where("_from <> _was").select(*by, "_from")
        placed = placed.join(few(known.select(*by, "_from")), by)
    else:
        placed = placed.withColumn("_from", F.col("_start"))
    return walked(placed, True).select(*rows.columns, *adds)


#: A block of ``gated`` is this many times ``least`` long.
SPAN = 10_000
#: Before all marks.
NEVER = -(1 << 62)


def gated(rows: DataFrame, keys: list[str], mark: str, reach: str, least: int, start: int, name: str, span: int = SPAN) -> DataFrame:
    """Rows with a boolean ``name``: whether a row opens, walked in the order of ``mark``, then ``reach``.

    A row opens if its ``reach`` is ``least`` or more past the mark of the last row that
    opened (``start`` before the first). Both are longs without nulls, and ``reach`` grows
    with ``mark`` (mark <= reach).

    Groups are cut into blocks of ``span`` times ``least`` of ``mark``. What a block does
    depends only on which of its first rows opens first, so a first pass walks from each of
    these at once (walks that open the same row are one from there on) and gives, for each
    block, the last mark by the first opening. A second pass, over these few rows a block,
    finds the mark that each block starts from; a third one gives the rows. The
    number of passes does not depend on the data, and a task holds no block, only the
    walks that have not met: at most as many as rows have their mark within ``least``.
    """
    by = [*keys, "_block"]
    placed = rows.withColumn("_block", F.floor(F.col(mark) / (span * max(least, 1))).cast("bigint"))
    schema = placed.schema
    of_walks = StructType([*[schema[k] for k in by], *[StructField(n, LongType()) for n in ("_nth", "_upto", "_ends")]])
    of_starts = StructType([*[schema[k] for k in by], StructField("_from", LongType())])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, walk = None, None
        for b in batches:
            out = []
            for *key, m, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != group:
                    if group is not None:
                        out += [(*group, n, *end) for n, end in enumerate(walk.ends())]
                    group, walk = key, _Walks(m + least)
                walk.add(m, r, least)
            if out:
                yield _batch(out, of_walks)
        if group is not None:
            yield _batch([(*group, n, *end) for n, end in enumerate(walk.ends())], of_walks)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, last, begin, met = None, None, start, start, False
        for b in batches:
            out = []
            for *key, at, _, upto, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != group:
                    group, block, last = key, None, start
                if at != block:
                    block, begin, met = at, last, False
                    out.append((*key, at, begin))
                if not met and upto - begin >= least:
                    last, met = ends, True
            if out:
                yield _batch(out, of_starts)

    first = placed.select(*by, mark, reach).repartition(*by).sortWithinPartitions(*by, mark, reach).mapInArrow(walks, of_walks)
    begins = first.repartition(*keys).sortWithinPartitions(*by, "_nth").mapInArrow(starts, of_starts)
    data = placed.unionByName(begins, allowMissingColumns=True)
    names = [*data.columns, name]
    at = [names.index(c) for c in (mark, reach, "_from")]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = start
        for b in batches:
            out = []
            for m, r, begin in zip(*(b.column(k).to_pylist() for k in at), strict=True):
                if begin is not None:
                    last = begin
                opens = begin is None and r - last >= least
                last = m if opens else last
                out.append(opens)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names)

    kinds = StructType([*[StructField(f.name, f.dataType) for f in data.schema.fields], StructField(name, BooleanType())])
    # the row that tells a block's start comes first
    dealt = data.repartition(*by).sortWithinPartitions(*by, F.col("_from").isNull(), mark, reach)
    return dealt.mapInArrow(opened, kinds).where("_from IS NULL").select(*rows.columns, name)


class _Walks:
    """Walks over a block from each row that may be the first to open there."""

    def __init__(self, until: int) -> None:
        self.until = until  # a first opening reaches this at the latest
        self.free = True
        self.upto: list[int] = []  # reach of the last row of each run of first openings
        self.walk: list[int] = []  # the walk of a run, or the one it went over into
        self.live: deque[tuple[int, int]] = deque()  # (last mark, walk), by mark

    def _root(self, k: int) -> int:
        while self.walk[k] != k:
            self.walk[k] = self.walk[self.walk[k]]
            k = self.walk[k]
        return k

    def add(self, m: int, r: int, least: int) -> None:
        joint = None
        while self.live and r - self.live[0][0] >= least:
            _, k = self.live.popleft()
            if joint is None:
                joint = k
            else:
                self.walk[k] = joint
        if self.live and self.live[-1][0] == m:
            if joint is not None:
                self.walk[joint] = self.live[-1][1]
            joint = self.live[-1][1]
        elif joint is not None:
            self.live.append((m, joint))
        if self.free:
            self.free = r < self.until
            if joint is None:
                joint = len(self.walk)
                self.live.append((m, joint))
            if self.walk and joint < len(self.walk) and self._root(len(self.walk) - 1) == joint:
                self.upto[-1] = r
            else:
                self.upto.append(r)
                self.walk.append(joint)

    def ends(self) -> Iterator[tuple[int, int]]:
        """(upto, last mark) in the order of the first openings; neighbours that end alike are one."""
        last = {k: m for m, k in self.live}
        run = None
        for k, upto in enumerate(self.upto):
            end = last[self._root(k)]
            if run is not None and end != run[1]:
                yield run
            run = (upto, end)
        if run is not None:
            yield run


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
