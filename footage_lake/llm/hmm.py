"""LM scoring: a hidden Markov language model over word classes.

Words are counted over all training documents. The ``OWN`` most frequent words are a
class each; the others fall into ``TAIL`` classes by their last letters, and the end
of a text is a class. A state emits a class, a class emits a word by its discounted
count, and what the discount frees is the share of unseen words in that class. So the
probability of a text is the forward recursion over its classes times the words'
shares, exactly.

The states start from chance and are trained by Baum-Welch passes, each over all training
documents: each task adds up expected counts, Spark sums them over the tasks in a tree,
and only sums, whose size is fixed, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from footage_lake.llm.common import id_bucket, shared_folder, stored

STATES = 8
OWN = 2048
TAIL = 1024
#: Letters at the end of a word that give its class.
ENDING = 2
#: Documents that share a word list, and their bytes: a list is closed with the document that reaches either.
CHUNK, CHUNK_BYTES = 3000, 1 << 24
#: Vectors of expected counts that one task adds up.
FAN = 16
#: Baum-Welch passes over all training documents.
PASSES = 14
#: The end of a text: no word has a blank.
END = " "
#: Steps of the forward recursion between two scalings.
STEPS = 8
#: Tokens whose probabilities are held at once.
HELD = 200_000
#: The same in training, where they are held in single precision; steps after which they are scaled.
TRAINED, SCALED = 400_000, 3


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row per class


def _blocks(sequences: list[np.ndarray], held: int | None = None) -> Iterator[np.ndarray]:
    """Numbers of sequences of like length, longest first, about ``held`` tokens (``HELD``) a block."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    part, size = [], 0
    for k in order:
        part.append(k)
        size += len(sequences[k])
        if size >= (held or HELD):
            yield np.array(part)
            part, size = [], 0
    if part:
        yield np.array(part)


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Tokens of sequences, longest first, by (time, sequence); how many go on at each time; the places of tokens with a next one."""
    sizes = np.array([len(s) for s in sequences])
    total, most = int(sizes.sum()), int(sizes[0])
    time = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(time.astype(np.uint16) if most <= 1 << 16 else time, kind="stable")
    going = np.searchsorted(-sizes, -np.arange(most), side="left")
    row = np.arange(total) - np.repeat(np.cumsum(going) - going, going)
    return np.concatenate(sequences)[order].astype(np.int64), going.tolist(), np.flatnonzero(row < np.repeat(np.append(going[1:], 0), going))


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence: the forward recursion, scaled every ``STEPS`` steps and at a sequence's end."""
    out, ones = np.zeros(len(sequences)), np.ones(len(model.start))
    for block in _blocks(sequences):
        if not len(sequences[block[0]]):
            continue
        flat, going, _ = _by_time([sequences[k] for k in block])
        seen, log, at = np.take(model.emit, flat, axis=0, mode="clip"), np.zeros(len(block)), 0
        for t, n in enumerate(going):
            alpha = seen[at : at + n]
            alpha *= model.start if t == 0 else np.dot(before[:n], model.move)
            ended = going[t + 1] if t + 1 < len(going) else 0
            if ended < n:
                log[ended:n] += np.log10(np.dot(alpha[ended:], ones))
            if t % STEPS == STEPS - 1:
                scale = np.dot(alpha[:ended], ones)
                alpha[:ended] /= scale[:, None]
                log[:ended] += np.log10(scale)
            before, at = alpha, at + n
        out[block] = log
    return out


def expected(model: Hmm, sequences: list[np.ndarray], sums: list[np.ndarray]) -> None:
    """Add the expected counts of starts, moves and emissions to ``sums``.

    Emissions are taken relative to their class, which counts do not depend on. Forward and
    backward rows are scaled every ``SCALED`` steps; what is left of the scale goes where
    a token's states, or its moves to the next one, are made to sum to one.
    """
    kind = np.float32
    emit = (model.emit / model.emit.sum(axis=1, keepdims=True)).astype(kind)
    start, move = model.start.astype(kind), model.move.astype(kind)
    back, ones = np.ascontiguousarray(move.T), np.ones(len(start), kind)
    rows, held = [s for s in sequences if len(s)], None
    for block in _blocks(rows, TRAINED):
        flat, going, source = _by_time([rows[k] for k in block])
        at = np.concatenate([[0], np.cumsum(going)]).tolist()
        if held is None or len(held[0]) < len(flat):
            held = [np.empty((len(flat), len(start)), kind) for _ in range(4)]
        seen, alpha, beta, ahead = (x[: len(flat)] for x in held)
        scale = np.ones(len(flat), kind)
        np.take(emit, flat, axis=0, out=seen, mode="clip")
        np.multiply(seen[: at[1]], start, out=alpha[: at[1]])
        for t in range(1, len(going)):
            now = alpha[at[t] : at[t + 1]]
            np.dot(alpha[at[t - 1] : at[t - 1] + going[t]], move, out=now)
            np.multiply(now, seen[at[t] : at[t + 1]], out=now)
            if t % SCALED == 0:
                now /= np.dot(now, ones, out=scale[at[t] : at[t + 1]])[:, None]
        beta.fill(1)
        for t in range(len(going) - 2, -1, -1):
            next_, now = slice(at[t + 1], at[t + 2]), beta[at[t] : at[t] + going[t + 1]]
            np.multiply(seen[next_], beta[next_], out=ahead[next_])
            np.dot(ahead[next_], back, out=now)
            if t % SCALED == 0:
                now /= np.dot(now, ones)[:, None]
        gamma = np.multiply(alpha, beta, out=beta)
        norm = np.dot(gamma, ones)
        gamma /= norm[:, None]
        if len(source):
            # a token's alpha before it was scaled, times its beta, is the norm of the moves to it
            to, of = ahead[at[1] :], seen[: len(source)]
            np.take(alpha, source, axis=0, out=of, mode="clip")
            to /= (norm * scale)[at[1] :, None]
            sums[1] += model.move * (of.T @ to)
        sums[0] += gamma[: at[1]].sum(axis=0)
        for k, weights in enumerate(np.ascontiguousarray(gamma.T)):
            sums[2][:, k] += np.bincount(flat, weights=weights, minlength=len(emit))


def _zeros(model: Hmm) -> list[np.ndarray]:
    return [np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)]


def remade(sums: list[np.ndarray], share: np.ndarray, weight: float = 50.0) -> Hmm:
    """Parameters from expected counts; ``share`` (of the classes) counts as ``weight`` tokens in each state."""
    start = sums[0] + 0.1
    move = sums[1] + 0.1
    emit = sums[2] + weight * share[:, None]
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def started(share: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
    """States that tend to stay and differ by chance."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * rng.gamma(2.0, 1.0, (len(share), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0, keepdims=True))


class _Numbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Chunk:
    """Documents as numbers into their common word list, and that list with training counts."""

    def __init__(self) -> None:
        self.local = _Numbers()
        self.ids, self.held, self.codes = [], [], []
        self.bytes = 0

    def add(self, doc_id, text: str | None, held: bool) -> None:
        raw = (text or "").encode().lower()
        words = raw.split()
        words.append(END.encode())
        self.codes.append(np.fromiter(map(self.local.__getitem__, words), "<u4", len(words)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.bytes += len(raw)

    def full(self) -> bool:
        return len(self.ids) >= CHUNK or self.bytes >= CHUNK_BYTES

    def counts(self) -> np.ndarray:
        train = [c for c, held in zip(self.codes, self.held, strict=True) if not held]
        return np.bincount(np.concatenate(train), minlength=len(self.local)) if train else np.zeros(len(self.local), np.int64)


def _word_lists(docs: DataFrame) -> Callable[[], DataFrame]:
    """Write, for reading back, the documents as numbers into their chunk's word list (kind 0) and the lists with training counts (kind 1).

    A chunk is a run of documents of one input task, so texts are not shuffled; its
    number is made of the task's number, and what is written is only what a finished
    task gave.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["kind", "chunk", "doc_id", "held_out", "codes", "word", "local", "n"]
    types = [pa.int32(), pa.int64(), to_arrow_type(kind), pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.int64()]

    def batch(columns: list) -> pa.RecordBatch:
        size = len(columns[1])
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def of_chunk(chunk: int, c: _Chunk) -> Iterator[pa.RecordBatch]:
        full = lambda value, size, t: np.full(size, value, t)
        yield batch([full(0, len(c.ids), np.int32), full(chunk, len(c.ids), np.int64), c.ids, c.held, [x.tobytes() for x in c.codes], None, None, None])
        n = c.counts()
        words = pa.array(list(c.local), pa.binary()).cast(pa.string())
        yield batch([full(1, len(n), np.int32), full(chunk, len(n), np.int64), None, None, None, words, np.arange(len(n), dtype=np.int32), n.astype(np.int64)])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, open_ = TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                open_.add(*row)
                if open_.full():
                    yield from of_chunk(chunk, open_)
                    chunk, open_ = chunk + 1, _Chunk()
        if open_.ids:
            yield from of_chunk(chunk, open_)

    schema = f"kind int, chunk bigint, doc_id {kind.simpleString()}, held_out boolean, codes binary, word string, local int, n bigint"
    path = shared_folder(docs.sparkSession)
    rows = docs.select("doc_id", "text", "held_out").mapInArrow(of_task, schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return lambda: docs.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class Shares:
    """What words get of their class: totals by class, from the counts of all training words."""

    total: int
    distinct: int
    tokens: np.ndarray
    words: np.ndarray
    once: np.ndarray
    twice: np.ndarray

    def logs(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; count 0: the class's share of unseen words."""
        discount = (self.once.sum() + 0.5) / (self.once.sum() + 2 * self.twice.sum() + 1.0)
        n, v = self.tokens[classes].astype(float), self.words[classes].astype(float)
        own = classes < OWN
        known = np.where(own, 1.0, np.maximum(counts - discount, 1e-9) / np.maximum(n, 1.0))
        unseen = np.where(n > 0, np.maximum(discount * v, 1e-9) / np.maximum(n, 1.0), 1.0)
        return np.log10(np.where(counts > 0, known, unseen))


def _tail_class(word) -> object:
    """Class of a word that has none of its own, from its last letters; the end of a text has the last class."""
    tail = F.lit(OWN) + F.pmod(F.xxhash64(F.right(word, F.lit(ENDING))), F.lit(TAIL))
    return F.when(word == END, F.lit(OWN + TAIL)).otherwise(tail).cast("int")


#: Words that very many chunks hold, at most, whose count is sent to their rows.
HOT_WORDS = 10_000


def _word_sums(lists: Callable[[], DataFrame]) -> DataFrame:
    """(word, c, chunks): a word's count in all training documents and the chunks that hold it; chunks count their words themselves."""
    rows = lists().where("kind = 1").select("word", "n")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")))


def _told(lists: Callable[[], DataFrame], words: DataFrame) -> DataFrame:
    """(chunk, local, c, class) of the words of each chunk, from ``words`` (word, c, chunks, class).

    A word has a row for each chunk that holds it. Words of very many rows are few, so
    these get theirs by a broadcast; only the rows of the other words are joined by a shuffle.
    """
    much = max(100, 2 * (words.agg(F.sum("chunks")).first()[0] or 0) // HOT_WORDS)
    of = words.select(F.col("word").alias("of_word"), "c", "class", "chunks")
    rows = lists().where("kind = 1").select("chunk", "local", "word")
    marked = rows.join(F.broadcast(of.where(F.col("chunks") > much).drop("chunks")), F.col("word") == F.col("of_word"), "left")
    rest = marked.where("c IS NULL").select("chunk", "local", "word").join(of.where(F.col("chunks") <= much), F.col("word") == F.col("of_word"))
    columns = ["chunk", "local", "c", "class"]
    return marked.where("c IS NOT NULL").select(columns).unionByName(rest.select(columns))


def _own_words(sums: DataFrame) -> list[str]:
    """The ``OWN`` most frequent words; ties by the word.

    A histogram of the counts tells first which words can be among them, so that
    tasks do not each send as many.
    """
    words = sums.where((F.col("c") > 0) & (F.col("word") != END)).withColumn("step", F.floor(8 * F.log2("c")).cast("int"))
    least, seen = 0, 0
    for r in sorted(words.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        least, seen = r["step"], seen + r["count"]
        if seen >= OWN:
            break
    return [r["word"] for r in words.where(F.col("step") >= least).orderBy(F.desc("c"), "word").limit(OWN).collect()]


def _encoded(lists: Callable[[], DataFrame], docs: DataFrame, known: DataFrame, shares: Shares) -> DataFrame:
    """Per document its classes, token counts, base score and the sum of its words' log shares."""
    kind = docs.schema["doc_id"].dataType
    rows = lists().where("kind = 0").select("chunk", "doc_id", "held_out", "codes")
    sent = docs.sparkSession.sparkContext.broadcast(shares)

    def of_chunk(docs_: pa.Table, list_: pa.Table) -> pa.Table:
        s = sent.value
        size = list_.num_rows
        count, cls = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = list_.column("local").to_numpy()
        count[at], cls[at] = list_.column("c").to_numpy(), list_.column("class").to_numpy()
        base = np.log10((count + 1) / (s.total + s.distinct + 1))
        share = s.logs(cls, count)
        out = [[], [], [], [], []]
        for codes in docs_.column("codes").to_pylist():
            k = np.frombuffer(codes, "<u4")
            for column, value in zip(out, (len(k), int((count[k] > 0).sum()), float(base[k].sum()), float(share[k].sum()), cls[k].astype("<u2").tobytes()), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.Table.from_arrays([docs_.column("doc_id"), docs_.column("held_out"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ENCODED)

    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, share_score double, classes binary"
    return stored(rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(of_chunk, schema))


#: Columns of the encoded documents.
ENCODED = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "share_score", "classes"]


def _summed(training: DataFrame, model: Hmm) -> list[np.ndarray]:
    """Expected counts over all rows: a vector for each task, added up ``FAN`` at a time."""
    sent = training.sparkSession.sparkContext.broadcast(model)
    zeros = _zeros(model)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _zeros(sent.value)
        for b in batches:
            expected(sent.value, [np.frombuffer(c, "<u2") for c in b.column(0).to_pylist()], sums)
        yield vector(TaskContext.get().partitionId(), np.concatenate([s.ravel() for s in sums]))

    def vector(task: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["task", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            yield vector(rows[0][0], sum(np.frombuffer(v) for _, v in rows))

    tasks = training.rdd.getNumPartitions()
    vectors = training.select("classes").mapInArrow(of_task, "task int, sums binary")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        vectors = vectors.repartition(tasks).mapInArrow(added, "task int, sums binary")
    rows = sorted((r["task"], bytes(r["sums"])) for r in vectors.collect())
    flat = sum((np.frombuffer(v) for _, v in rows), np.zeros(sum(z.size for z in zeros)))
    cut = np.cumsum([z.size for z in zeros])[:-1]
    return [p.reshape(z.shape) for p, z in zip(np.split(flat, cut), zeros, strict=True)]


def train(encoded: DataFrame, share: np.ndarray, passes: int = PASSES) -> Hmm:
    """Baum-Welch passes over all training documents."""
    training = encoded.where(~F.col("held_out"))
    model = started(share)
    if training.isEmpty():
        return model
    for _ in range(passes):
        model = remade(_summed(training, model), share)
    return model


@dataclass
class Fitted:
    """What is learned: the model, the words' shares, the words that are classes; and the encoded documents."""

    model: Hmm
    shares: Shares
    own: list[str]
    encoded: DataFrame


def fitted(documents: DataFrame) -> Fitted:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "held_out", id_bucket(F.col("doc_id"), 7) == 2
    )
    lists = _word_lists(docs)
    words = _word_sums(lists)
    own = _own_words(words)
    table = documents.sparkSession.createDataFrame([(w, k) for k, w in enumerate(own)], "own_word string, own_class int")
    words = words.join(F.broadcast(table), F.col("word") == F.col("own_word"), "left").withColumn("class", F.coalesce("own_class", _tail_class(F.col("word"))))
    by_class = words.where(F.col("c") > 0).groupBy("class").agg(
        F.sum("c").alias("tokens"), F.count("*").alias("words"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    )
    size = OWN + TAIL + 1
    sums = {k: np.zeros(size, np.int64) for k in ("tokens", "words", "once", "twice")}
    for r in by_class.collect():
        for k, v in sums.items():
            v[r["class"]] = r[k]
    shares = Shares(int(sums["tokens"].sum()), int(sums["words"].sum()), **sums)
    encoded = _encoded(lists, docs, _told(lists, words), shares)
    share = (sums["tokens"] + 0.5) / (sums["tokens"].sum() + 0.5 * size)
    return Fitted(train(encoded, share), shares, own, encoded)


def scored(documents: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts consist of the end alone. Texts of any length are scored whole.
    Repeated rows score alike; an empty table gives no rows; without a training document
    all counts are zero. Other columns are ignored, whatever their names.
    """
    return scores(fitted(documents))


def scores(fit: Fitted) -> DataFrame:
    """The forward recursion over the encoded documents."""
    sent = fit.encoded.sparkSession.sparkContext.broadcast(fit.model)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            log = forward(sent.value, [np.frombuffer(c, "<u2") for c in b.column("classes").to_pylist()])
            arrays = [*(b.column(k) for k in ENCODED[:5]), pa.array(log + b.column("share_score").to_numpy())]
            yield pa.RecordBatch.from_arrays(arrays, [*ENCODED[:5], "score"])

    kind = fit.encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return fit.encoded.select(*ENCODED).mapInArrow(of_batch, schema).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(fit.shares.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
