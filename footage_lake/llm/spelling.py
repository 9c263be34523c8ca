"""Spelling variants: words one edit apart, found in bidirectional FM-indexes.

If two words are one edit apart, one half of the longer word (or of either, at equal
length) stands unchanged at the same end of the other. So each word is dealt to the
keys of its halves, and what shares a key meets in a task. There the words of some keys
form one text, ``$`` before and after each, with an index of its suffixes and one of the
suffixes of its reversal. A query matches a half from the word's middle outwards to the
``$`` at its end, then goes on across the other half with at most one error. Both
directions share a state: an interval of suffix ranks in each index, of one size. As the
words are sorted, the rank of the suffix that begins with ``$word$`` is the word's number.

The longer word asks for the shorter one, and of two words of one length each asks for
the other; a pair is told once, then stated for both its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footage_lake.llm.common import discard, shared_folder, small, stored

#: Code points and occurrences of a word, at least.
LETTERS, OCCURRENCES = 5, 3
#: A word's form is at least so many times as frequent.
TIMES = 2
#: Of so many runs one, by its hash, has lost a letter.
SLIPS = 97
#: Characters of the words in one index, about: keys are added until they reach it.
INDEX_CHARS = 1 << 17
#: Words under one key that are indexed together; a key of more is cut into parts, and its queries go to all of them.
PART = 8192
#: Words of a task that are counted together, and their letters.
COUNTED, COUNTED_CHARS = 400_000, 8_000_000


# ---------------------------------------------------------------- words


def _runs_of(letters: int) -> re.Pattern:
    """Maximal runs of at least so many letters; ASCII ones are in lower case."""
    return re.compile(f"[a-zÀ-ÿ]{{{letters},}}")


def word_counts(documents: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n) over all documents; a word may come in several rows, which have to be added up.

    A run whose hash with the doc_id is divisible by ``SLIPS`` loses the letter at the
    hash's place. Tasks add up what they read, as far as their table holds.
    """
    runs = _runs_of(letters)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[str, int] = {}
                for run in runs.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                    own[run] = own.get(run, 0) + 1
                head = zlib.crc32(f"{doc}:".encode())
                for run, n in own.items():
                    h = zlib.crc32(run.encode(), head)
                    if h % SLIPS == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < letters:
                            continue
                    if run in total:
                        total[run] += n
                    else:
                        total[run] = n
                        size += len(run)
                if len(total) >= COUNTED or size >= COUNTED_CHARS:
                    yield rows()
                    total.clear()
                    size = 0
        if total:
            yield rows()

    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents.select(named.alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of_batch, "word string, n bigint")


def vocabulary(documents: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words of at least so many letters and occurrences in all documents."""
    return word_counts(documents, letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# ---------------------------------------------------------------- the index


@dataclass
class States:
    """Searches under way: the query of each, where its intervals begin in either index, and their size."""

    query: np.ndarray
    low: tuple[np.ndarray, np.ndarray]
    size: np.ndarray

    def take(self, rows: np.ndarray) -> States:
        return States(self.query[rows], (self.low[0][rows], self.low[1][rows]), self.size[rows])


def _joined(parts: list[States]) -> States:
    return States(np.concatenate([p.query for p in parts]), tuple(np.concatenate([p.low[d] for p in parts]) for d in (0, 1)), np.concatenate([p.size for p in parts]))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling the length that the ranks compare."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank[order] = step
        if step[-1] == n - 1:
            return order
        width *= 2


class BiIndex:
    """Sorted, distinct words as one delimited text, and both ways to search it.

    ``less[d][i, c]`` counts the characters smaller than c among the first i of the
    transformed text; d is 0 for the text (it extends to the left) and 1 for its reversal
    (to the right). Character 0 is the delimiter.
    """

    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        self.alphabet, text = np.unique(points, return_inverse=True)
        n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet)))]).astype(np.int32)
        self.less = []
        for t in (text, text[::-1]):
            before = t[suffix_order(t) - 1]
            seen = np.zeros((n + 1, len(self.alphabet) + 1), np.int32)
            seen[np.arange(1, n + 1), before + 1] = 1
            np.cumsum(seen, axis=0, out=seen)
            np.cumsum(seen, axis=1, out=seen)
            self.less.append(seen)
        self.length = n

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the words one after the other, -1 where no word of the index has it, and where each word begins."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    def extended(self, states: States, side: int, char: np.ndarray) -> States:
        """The searches with one more character on their left (side 0) or right (1); those that match nothing end."""
        known = np.flatnonzero(char >= 0)
        if len(known) < len(char):
            states, char = states.take(known), char[known]
        low, less = states.low[side], self.less[side]
        high = low + states.size
        smaller_low, smaller_high = less[low, char], less[high, char]
        equal_low, equal_high = less[low, char + 1] - smaller_low, less[high, char + 1] - smaller_high
        own, other = self.first[char] + equal_low, states.low[1 - side] + smaller_high - smaller_low
        out = States(states.query, (own, other) if side == 0 else (other, own), equal_high - equal_low)
        return out.take(np.flatnonzero(out.size > 0))

    def branches(self, states: States, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(state, character) for each character but the delimiter that some match of the state has next on that side."""
        low, less = states.low[side], self.less[side]
        counts = np.diff(less[low + states.size] - less[low], axis=1)
        state, char = np.nonzero(counts[:, 1:])
        return state, char + 1

    def one_edit(self, words: list[str], side: int, longer: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number) of words one edit away: equal in the half that lies opposite to ``side``, the edit on ``side``.

        ``side`` 1: the left half (shorter by one at odd lengths) is matched outwards to
        the left, then the right one with an error; 0: the other way round. Without
        ``longer`` only words as long as the query or shorter by one are searched.
        """
        code, start = self.coded(words)
        n = np.diff(start)
        half = n // 2
        every = np.arange(len(words))
        states = States(every, (np.zeros(len(words), np.int64),) * 2, np.full(len(words), self.length, np.int64))
        exact = half if side == 1 else n - half
        back = 1 - side
        middle = start[:-1] + half

        def char_at(rows: States, depth: int, toward: int) -> np.ndarray:
            """The query's character so far from its middle."""
            return code[middle[rows.query] + depth] if toward == 1 else code[middle[rows.query] - 1 - depth]

        waiting: list[States] = []  # whose half is matched
        depth = 0
        while len(states.query):
            done = exact[states.query] == depth
            if done.any():
                waiting.append(states.take(np.flatnonzero(done)))
                states = states.take(np.flatnonzero(~done))
            states = self.extended(states, back, char_at(states, depth, back))
            depth += 1
        if not waiting:
            return every[:0], every[:0]
        clean = _joined(waiting)
        clean = self.extended(clean, back, np.zeros(len(clean.query), np.int64))
        rest = n - exact
        none = clean.take(np.zeros(0, np.int64))
        wrong, found, depth = none, [], 0
        while len(clean.query) or len(wrong.query):
            ended = rest[wrong.query] == depth
            found.append(self.extended(wrong.take(np.flatnonzero(ended)), side, np.zeros(int(ended.sum()), np.int64)))
            wrong = wrong.take(np.flatnonzero(~ended))
            more = [self.extended(wrong, side, char_at(wrong, depth, side))]
            inner = np.flatnonzero(rest[clean.query] > depth)
            state, char = self.branches(clean, side)
            if longer:  # a character more in the word: at this depth with an error
                added = self.extended(clean.take(state), side, char)
                end = rest[added.query] == depth
                found.append(self.extended(added.take(np.flatnonzero(end)), side, np.zeros(int(end.sum()), np.int64)))
                added = added.take(np.flatnonzero(~end))
                more.append(self.extended(added, side, char_at(added, depth, side)))
            clean, place = clean.take(inner), np.full(len(clean.query), -1)
            place[inner] = np.arange(len(inner))
            said = char_at(clean, depth, side)
            state, char = place[state[place[state] >= 0]], char[place[state] >= 0]
            other = char != said[state]
            more += [self.extended(clean.take(state[other]), side, char[other]), clean]  # another character; one less
            clean = self.extended(clean, side, said)
            wrong = _joined(more)
            depth += 1
        ends = _joined(found) if found else none
        pairs = np.unique(ends.query * np.int64(self.length + 1) + ends.low[0] - 1)
        return pairs // (self.length + 1), pairs % (self.length + 1)


# ---------------------------------------------------------------- the job


def _dealt(words: DataFrame) -> DataFrame:
    """(side, key, word, n, own, held): each word under the halves by which a query may meet it; ``own`` where it is a query.

    A query of L letters has halves of L div 2 and L - L div 2. A word of L letters is
    met by queries of L and L + 1.
    """
    length = F.length("word")
    rows = words.select(
        "word",
        "n",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.array(
                        F.transform(F.array(length, length + 1), lambda q: F.struct(F.lit(1).alias("side"), F.floor(q / 2).cast("int").alias("half"))),
                        F.transform(F.array(length, length + 1), lambda q: F.struct(F.lit(0).alias("side"), F.ceil(q / 2).cast("int").alias("half"))),
                    )
                )
            )
        ).alias("at"),
    )
    side, half = F.col("at.side"), F.col("at.half")
    own = half == F.when(side == 1, F.floor(length / 2)).otherwise(F.ceil(length / 2)).cast("int")
    key = F.when(side == 1, F.substr("word", F.lit(1), half)).otherwise(F.right("word", half))
    return rows.select(side.alias("side"), key.alias("key"), "word", "n", own.alias("own"), F.lit(True).alias("held"))


def _parted(rows: DataFrame, part: int = PART) -> DataFrame:
    """Rows with ``part``: keys of over ``part`` words are cut, their words indexed in one part each and asked for in all."""
    large = stored(rows.groupBy("side", "key").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where(F.col("parts") > 1))
    n = large.count()
    if not n:
        return rows.withColumn("part", F.lit(0))
    marked = rows.join(small(large, n), ["side", "key"], "left")
    dealt = marked.where(F.col("parts").isNotNull()).withColumn("home", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))))
    return marked.where(F.col("parts").isNull()).select(*rows.columns, F.lit(0).alias("part")).unionByName(
        dealt.withColumn("held", F.col("part") == F.col("home")).select(*rows.columns, "part")
    )


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[tuple]]:
    """Rows of whole parts of keys of one side, about ``chars`` characters of words together."""
    rows, size, at = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place = row[0], row[1], row[2]
            if place != at:
                if rows and (size >= chars or at[0] != row[0]):
                    yield rows
                    rows, size = [], 0
                at = place
            rows.append(row)
            size += len(row[3]) + 1
    if rows:
        yield rows


def _near_pairs(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (side, key, part, word, n, own, held) sorted by the first three in; (word, near, near_n) out, for both words of a pair."""
    for rows in _chunks(batches, chars):
        side = rows[0][0]
        count = {r[3]: r[4] for r in rows}
        held, asked = sorted({r[3] for r in rows if r[6]}), sorted({r[3] for r in rows if r[5]})
        home = {(r[1], r[3]) for r in rows if r[6]}  # of a key in parts, a word of another part may be held here by another key
        if not held or not asked:
            continue
        query, number = BiIndex(held).one_edit(asked, side)
        word, near, near_n = [], [], []
        for q, k in zip(query.tolist(), number.tolist(), strict=True):
            a, b = asked[q], held[k]
            left, right = a[: len(a) // 2], a[len(a) // 2 :]
            if (left if side == 1 else right, b) not in home or side == 0 and b.startswith(left):
                continue  # another part or the other side tells it
            word.append(a)
            near.append(b)
            near_n.append(count[b])
            if len(a) > len(b):
                word.append(b)
                near.append(a)
                near_n.append(count[a])
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, chars: int = INDEX_CHARS, part: int = PART) -> DataFrame:
    """(word, near, near_n): each ordered pair of words (word, n) that are one edit apart, once.

    ``words`` holds each word once, of two letters at least; it is read twice.
    """
    rows = _parted(_dealt(words), part).select("side", "key", "part", "word", "n", "own", "held")
    dealt = rows.repartition("side", "key", "part").sortWithinPartitions("side", "key", "part")
    return dealt.mapInArrow(lambda it: _near_pairs(it, chars), "word string, near string, near_n bigint")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): for (word, form) the end of each chain of forms of up to 2 ** rounds steps, by pointer doubling."""
    spark, path = forms.sparkSession, None
    ahead = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        old, path = path, shared_folder(spark)
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = stored(ahead.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), path)
        if old:
            discard(spark, old)
    return ahead


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of a table (word, n) that holds each once.

    The form is the near word of largest n, of equal ones the first in code-point order,
    where that n is at least ``times`` (over 1) the word's; without one form and form_n
    are null and the root is the word itself. Along forms n grows by that factor, so
    chains are short and end. An empty table gives no rows.
    """
    words = stored(words.select("word", "n"))
    pairs = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "near", "near_n")
    every = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(pairs)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    found = every.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    likely: Column = -F.col("best.minus") >= times * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.minus")).alias("form_n")))
    least, most = words.agg(F.min("n"), F.max("n")).first()
    steps = int(np.log(most / least) / np.log(times)) + 1 if most else 0
    last = roots(found.where(F.col("form").isNotNull()), max(1, int(np.ceil(np.log2(steps + 1)))))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(documents: DataFrame) -> DataFrame:
    """``variants`` of the words of all documents.

    Null and empty texts hold no word; a null doc_id counts as the empty string; repeated
    rows count as often as they come. Texts of any length are read whole, and words may
    be of any length. An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    return variants(vocabulary(documents))
