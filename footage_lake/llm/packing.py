"""Packing: documents into token sequences of a fixed length with little padding.

Each task packs the documents of its own input blocks, so nothing is shuffled. A
document longer than a sequence is first cut into full windows. The rest pieces go
longest first into the open window whose room is tightest, found by a segment tree
over room sizes. What is then left of half-filled windows is closed up: pieces of
the emptiest are cut into the gaps of the fullest, and the one window that remains
at the end of a task is laid out as sequences of power-of-two length, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from footage_lake.llm import bpe

LENGTH = 2048
END = 1

COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: (document number in the block, start, length)
Piece = tuple[int, int, int]


class RoomTree:
    """Open windows by room: a segment tree over 0..length counts windows, leaves hold their numbers."""

    def __init__(self, length: int) -> None:
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        at = self.base + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the smallest room that is at least ``need``, taken out; none: None."""
        at = self.base + need
        while not self.count[at]:
            while at & 1:  # a right child: up
                at >>= 1
            if at == 0:
                return None
            at += 1  # the right sibling
            if at & (at - 1) == 0:  # past the last leaf of its level
                return None
        while at < self.base:
            at *= 2
            if not self.count[at]:
                at += 1
        room = at - self.base
        window = self.windows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, window


def best_fit(pieces: list[Piece], length: int = LENGTH) -> list[list[Piece]]:
    """Best-fit decreasing of pieces no longer than ``length``; ties by document, then start."""
    tree, windows = RoomTree(length), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        found = tree.take(piece[2])
        if found is None:
            windows.append([piece])
            tree.add(length - piece[2], len(windows) - 1)
        else:
            room, w = found
            windows[w].append(piece)
            tree.add(room - piece[2], w)
    return windows


def close_up(windows: list[list[Piece]], length: int = LENGTH) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces left over, less than one window) by cutting pieces of the emptiest windows."""
    size = lambda w: sum(p[2] for p in w)
    full = [w for w in windows if size(w) == length]
    rest = sorted((w for w in windows if size(w) < length), key=size)
    low, high = 0, len(rest) - 1
    while low < high:
        gap = length - size(rest[high])
        while gap and low < high:
            donor = rest[low]
            doc, start, n = donor.pop()
            if n > gap:
                donor.append((doc, start, n - gap))
                doc, start, n = doc, start + n - gap, gap
            rest[high].append((doc, start, n))
            gap -= n
            if not donor:
                low += 1
        if gap == 0:
            full.append(rest[high])
            high -= 1
    return full, rest[low] if low <= high and low < len(rest) else []


def power_lengths(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces as sequences whose lengths are the powers of two in their sum, longest first."""
    out, left = [], list(reversed(pieces))
    total = sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, row = 1 << bit, []
        while room:
            doc, start, n = left.pop()
            if n > room:
                left.append((doc, start + room, n - room))
                n = room
            row.append((doc, start, n))
            room -= n
        out.append(row)
    return out


def pack_block(sizes: list[int], length: int = LENGTH) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows for documents of these sizes, and the pieces of less than one window left over."""
    windows, pieces = [], []
    for doc, n in enumerate(sizes):
        cut = n - n % length
        windows += [[(doc, at, length)] for at in range(0, cut, length)]
        if n > cut:
            pieces.append((doc, cut, n - cut))
    full, rest = close_up(best_fit(pieces, length), length)
    return windows + full, rest


def packed(documents: DataFrame, path: str = bpe.VOCABULARY, length: int = LENGTH) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and the end id, so null and empty
    texts have one token. Repeated rows are packed as often as they come; an
    empty table gives no rows; other columns are ignored, whatever their names. Texts of
    any length are packed whole. A sequence belongs to
    one task, whose number makes the upper half of its id.
    """

    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((k, pa.int64()) for k in COLUMNS)])

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        task = TaskContext.get().partitionId() << 32
        sequence = 0
        held: list[tuple[object, np.ndarray, int, int, int]] = []  # of the last block: id, tokens, start, doc_tokens, length
        end = np.array([END], "<u4").tobytes()

        def rows(windows, doc_ids, tokens, starts, totals) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for w in windows:
                offset = 0
                for doc, start, n in w:
                    crc = zlib.crc32(tokens[doc][start : start + n])
                    out.append((doc_ids[doc], starts[doc] + start, n, crc, totals[doc], task + sequence, offset))
                    offset += n
                sequence += 1
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for block in batches:
            doc_ids = [h[0] for h in held] + block.column(0).to_pylist()
            tokens = [h[1] for h in held]
            tokens += [np.frombuffer(ids + end, "<u4") for ids in encoder.ids_of(block.column(1).to_pylist())]
            starts = [h[2] for h in held] + [0] * block.num_rows
            totals = [h[3] for h in held] + [len(t) for t in tokens[len(held) :]]
            windows, rest = pack_block([len(t) for t in tokens], length)
            yield rows(windows, doc_ids, tokens, starts, totals)
            held = [(doc_ids[d], tokens[d][s : s + n].copy(), starts[d] + s, totals[d], n) for d, s, n in rest]
        if held:
            pieces = [(k, 0, h[4]) for k, h in enumerate(held)]
            yield rows(power_lengths(pieces), *([h[k] for h in held] for k in range(4)))

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        of_batch, f"doc_id {kind.simpleString()}, " + ", ".join(f"{k} bigint" for k in COLUMNS)
    )
