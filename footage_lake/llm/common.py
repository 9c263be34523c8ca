"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer does."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a block of ``running``.
_RUN = 256


def running(values: Column, zero: Column, plus) -> Column:
    """Element k is ``plus`` over the elements of ``values`` before it, from ``zero``; ``plus`` is associative.

    A fold that appends to an array copies it at each step, so the array is cut into
    blocks: the totals of the blocks are run up first, then the elements of each.
    """

    def up(array: Column, first: Column, last: Column, start: Column) -> Column:
        """Running values of the elements ``first`` to ``last``."""
        begin = F.struct(F.array().cast("array<int>").alias("rows"), start.alias("at"))
        step = lambda acc, k: F.struct(F.array_append(acc["rows"], acc["at"]).alias("rows"), plus(acc["at"], F.get(array, k)).alias("at"))
        return F.aggregate(F.sequence(first, last), begin, step, lambda acc: acc["rows"])

    def of_array(v: Column) -> Column:
        n = F.size(v)
        starts = F.sequence(F.lit(0), n - 1, F.lit(_RUN))
        last = lambda s: F.least(s + _RUN, n) - 1
        totals = F.transform(starts, lambda s: F.aggregate(F.sequence(s, last(s)), zero, lambda acc, k: plus(acc, F.get(v, k))))
        before = let(totals, lambda t: up(t, F.lit(0), F.size(t) - 1, zero))
        rows = F.flatten(F.zip_with(starts, before, lambda s, b: up(v, s, last(s), b)))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(rows)

    return let(values, of_array)


def found_before(n: Column, holds) -> Column:
    """How many of the indices 0 to n - 1 satisfy ``holds``, which is true for the first of them: a binary search."""

    def step(acc: Column, _: Column) -> Column:
        def halved(mid: Column) -> Column:
            right = F.coalesce(holds(mid), F.lit(False))
            return F.struct(F.when(right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(mid).alias("high"))

        return F.when(acc["low"] < acc["high"], let(F.floor((acc["low"] + acc["high"]) / 2).cast("int"), halved)).otherwise(acc)

    start = F.struct(F.lit(0).alias("low"), n.cast("int").alias("high"))
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.when(n > 0, F.aggregate(halvings, start, step, lambda acc: acc["low"])).otherwise(F.lit(0))


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six blanks."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus), F.lit(0).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder in spark.checkpoint.dir, which all executors share.

    Unset, a session in one process gets a folder of its own, which it remembers; on a
    cluster that is an error, as each executor would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("footage_lake.scratch", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("footage_lake.scratch", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here."""
    path = path or shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``stored`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh_name(frame: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of keys that are broadcast at most; more are joined by a shuffle.
FEW = 500_000


def small(frame: DataFrame, n: int) -> DataFrame:
    """``frame`` of ``n`` rows, to be broadcast if these are few."""
    return F.broadcast(frame) if n <= FEW else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thinned(frame: DataFrame, key: Column, rows: int, n: int | None = None) -> DataFrame:
    """About twice ``rows`` rows of a larger table, chosen by a hash of the key.

    For a bounded sample: an ordering with a limit would send ``rows`` rows of each
    task to the driver, so the tasks first leave out what cannot be needed. Where
    keys repeat, ``n`` is the number of distinct ones.
    """
    n = frame.count() if n is None else n
    share = min(1.0, 2 * max(rows, 500) / max(n, 1))
    return frame if share == 1.0 else frame.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(share * (1 << 30)))


#: Vectors that one task adds up.
FAN = 16


def tree_sum(rows: DataFrame, of_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: type) -> np.ndarray:
    """The sum over the tasks of the vector that ``of_task`` makes of a task's batches; shorter vectors end in zeros.

    Vectors are added up ``FAN`` at a time in tasks, then the last few on the driver, in
    the order of the tasks' numbers in each. Without a task: no entries.
    """

    def row(task: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], ["task", "total"])

    def added(parts: list[tuple[int, bytes]]) -> np.ndarray:
        vectors = [np.frombuffer(v, kind) for _, v in sorted(parts)]
        out = np.zeros(max(map(len, vectors), default=0), kind)
        for v in vectors:
            out[: len(v)] += v
        return out

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(TaskContext.get().partitionId(), of_task(batches))

    def next_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if parts:
            yield row(min(parts)[0], added(parts))

    tasks = rows.rdd.getNumPartitions()
    vectors = rows.mapInArrow(first, "task int, total binary")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        vectors = vectors.repartition(tasks).mapInArrow(next_, "task int, total binary")
    return added([(r["task"], bytes(r["total"])) for r in vectors.collect()])
