"""Document fingerprints: a quartile bucket digest and a bounded difference score.

Byte triplets of a window of five are hashed into buckets. The digest says for each
bucket in which quartile of the counts it lies, and for the whole text its length on
a logarithmic scale and two ratios of quartiles. Digests are compared bucket by bucket.

The pairing of each document with the next one by id needs no global sort in one
task: Spark cuts the ids into ranges, each range is sorted by itself, and only the
last document of a range waits for the first one of the range after it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from footage_lake.llm.common import stored

#: Buckets of the digest; two bits each.
BUCKETS = 256
#: Places of the triplets in a window of five bytes, and the salt of each.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
SALTS = (2, 3, 5, 7, 11, 13)
_BLOCK = 1 << 20


def _counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets over all windows; shorter texts are padded with zero bytes."""
    raw = np.frombuffer(data.ljust(5, b"\0") if data else b"", np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(raw) - 4, 0), _BLOCK):
        part = raw[at : at + _BLOCK + 4]
        n = len(part) - 4
        for (i, j, k), salt in zip(TRIPLETS, SALTS, strict=True):
            h = part[i : i + n] * np.uint32(0x9E3779B1)
            h = ((h ^ part[j : j + n]) + np.uint32(salt)) * np.uint32(0x85EBCA77)
            h = (h ^ part[k : k + n]) * np.uint32(0xC2B2AE3D)
            out += np.bincount((h >> np.uint32(24)).astype(np.intp) % BUCKETS, minlength=BUCKETS)
    return out


def digest(text: str | None) -> str:
    """Hex digest: length (2 digits), quartile ratios (2), buckets (two bits each). Empty texts have one too."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = _counts(data)
    q1, q2, q3 = (int(np.sort(counts)[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    level = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.unpackbits(level.reshape(-1, 1), axis=1)[:, 6:].reshape(-1)).tobytes()
    length = min(255, round(12 * math.log2(len(data) + 1)))
    ratio = (16 * q1 // max(q3, 1)) % 16 << 4 | (16 * q2 // max(q3, 1)) % 16
    return f"{length:02x}{ratio:02x}{body.hex()}"


def _levels(print_: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(print_[4:]), np.uint8)).reshape(-1, 2)
    return bits[:, 0] * 2 + bits[:, 1].astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, towards 0 the more buckets, length and ratios differ.

    A bucket one quartile off costs 1, two off 2, three off 6; texts without
    anything in common cost about 1.4 a bucket, which counts as no likeness.
    """
    if a == b:
        return 1.0
    off = np.abs(_levels(a) - _levels(b))
    cost = float(off.sum() + 3 * (off == 3).sum())
    cost += abs(int(a[:2], 16) - int(b[:2], 16)) / 4
    for k in (2, 3):
        step = abs(int(a[k], 16) - int(b[k], 16))
        cost += min(step, 16 - step) / 2
    return max(0.0, 1.0 - cost / (1.4 * BUCKETS))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following`` (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    """The columns of a document and the one after it."""
    new = edited(text, following)
    of_new = digest(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark, of_new, likeness(mark, of_new), likeness(mark, next_mark)


def fingerprint_report(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. Order is by doc_id (of any type), null ids first;
    rows of one id follow each other in the order of a hash of their texts. A single
    document is its own next one. Repeated rows are neighbours of each other; an
    empty table gives no rows; other columns are ignored, whatever their names. Texts of
    any length are counted whole. ``ranges`` is the number of
    tasks, by default that of the input or of the session's shuffles.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # the last two only cut an id of very many rows; where they come from decides between equal rows
    keys = ["doc_id", F.xxhash64("text"), F.spark_partition_id()]
    names = [*COLUMNS, "part", "place", "text"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents whose next one is here; the first and last one with their texts, place 'first' and 'last'."""
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held = None

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mark = digest(text)
                if held is None:
                    out.append((doc_id, None, None, mark, None, None, None, part, "first", text))
                else:
                    out.append((*_compared(*held, text, mark), part, None, None))
                held = (doc_id, text, mark)
                if len(out) >= 2000:
                    yield batch()
        if held is not None:
            out.append((held[0], None, None, held[2], None, None, None, part, "last", held[1]))
        yield batch()

    shape = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(ranges, *keys).sortWithinPartitions("doc_id", "h", "text")
    rows = stored(ranged.select("doc_id", "text").mapInArrow(of_range, f"{shape}, part int, place string, text string"))
    parts = sorted(r["part"] for r in rows.where("place = 'first'").select("part").collect())
    follows = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, next_part int")
    firsts = rows.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    lasts = rows.where("place = 'last'").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follows), "part").join(firsts, "next_part")

    def of_border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_compared(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(COLUMNS)], strict=True)], COLUMNS)

    borders = lasts.select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(of_border, shape)
    return rows.where("place IS NULL").select(*COLUMNS).unionByName(borders)
