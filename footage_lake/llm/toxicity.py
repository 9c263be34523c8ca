"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: words and the first letters of longer
words. The machine adds to the terms' weights a product of factors for each pair of
terms, so that an insult next to a mention of a group weighs more than both alone.
It is fitted on the driver to a bounded sample (``SAMPLE`` labelled documents, the
``TERMS`` hashed terms that tell the labels apart best) and sent to the scoring
tasks; its size does not depend on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footage_lake.llm.common import id_bucket, thinned

#: Labelled documents that the machine is fitted to, at most.
SAMPLE = 8000
#: Hashed terms that the machine keeps.
TERMS = 768
BUCKETS = 1 << 20
FACTORS = 4
#: Weight of a toxic row in the loss, a clean one being 1.
POSITIVE = 6.0
PREFIX = 5
THRESHOLD = 0.7
#: Words of up to ``KEPT_LETTERS`` that a worker remembers; then it starts anew.
KEPT, KEPT_LETTERS = 200_000, 64
_WORD = re.compile(r"[^\W\d_]+")


def _buckets(word: str) -> tuple[int, ...]:
    """Hashed terms of a word in lower case: itself and, if longer, its first letters."""
    whole = xxhash.xxh32_intdigest(word) % BUCKETS
    if len(word) <= PREFIX:
        return (whole,)
    return whole, xxhash.xxh32_intdigest("^" + word[:PREFIX]) % BUCKETS


def terms(text: str | None) -> list[int]:
    """The distinct hashed terms of the whole text; none for a null or empty one."""
    words = set(_WORD.findall((text or "").lower()))
    return sorted({b for w in words for b in _buckets(w)})


@dataclass
class Machine:
    """Weights of the kept terms. ``place`` maps a hashed term to its row."""

    place: dict[int, int]
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weight[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30))))


def fit(rows: list[tuple[np.ndarray, int]], n_terms: int = TERMS, factors: int = FACTORS, steps: int = 250, seed: int = 1) -> Machine:
    """Adam on the logistic loss over all rows at once.

    Terms are chosen by their likelihood ratio; a sample of one class or none gives
    a machine without terms, whose score is that class's share of the rows.
    """
    y = np.array([t for _, t in rows], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    empty = Machine({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    if not len(y) or y.min() == y.max():
        return empty
    found = np.concatenate([b for b, _ in rows]).astype(np.int64)
    label = np.repeat(y, [len(b) for b, _ in rows])
    n_pos, n_neg = np.bincount(found[label > 0], minlength=BUCKETS), np.bincount(found[label == 0], minlength=BUCKETS)
    seen = np.flatnonzero(n_pos + n_neg >= 3)
    p, n, all_p, all_n = n_pos[seen], n_neg[seen], y.sum(), len(y) - y.sum()
    expect = (p + n) / len(y)
    gain = p * np.log(np.maximum(p, 0.5) / (all_p * expect)) + n * np.log(np.maximum(n, 0.5) / (all_n * expect))
    kept = seen[np.lexsort((seen, -gain))[:n_terms]]
    place = {int(b): k for k, b in enumerate(kept)}
    x = np.zeros((len(rows), len(kept)), np.float32)
    for k, (b, _) in enumerate(rows):
        x[k, [place[i] for i in b.tolist() if i in place]] = 1
    each = np.where(y > 0, POSITIVE, 1.0)
    each /= each.sum()
    rng = np.random.default_rng(seed)
    state = [np.array(empty.bias), np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), factors))]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    decay = (0.0, 2e-3, 1e-2)
    for step in range(1, steps + 1):
        w0, w, v = state
        v32 = v.astype(np.float32)
        inner = x @ v32
        raw = w0 + x @ w.astype(np.float32) + 0.5 * ((inner**2).sum(axis=1) - x @ (v32**2).sum(axis=1))
        miss = (((1 / (1 + np.exp(-np.clip(raw, -30, 30)))) - y) * each).astype(np.float32)
        down = miss @ x
        grads = [miss.sum(), down + decay[1] * w / 10, x.T @ (miss[:, None] * inner) - v * down[:, None] + decay[2] * v / 10]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            state[k] = state[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(place, float(state[0]), state[1], state[2])


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on up to ``sample`` labelled documents with crc32(doc_id) mod 3 other than 1, chosen by a hash of the id.

    Null labels and ids without a document are left out. Of labels that repeat an id
    the least counts, of documents that do the one of the least terms, so that the
    sample keeps its bound.
    """
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isNotNull() & F.col("label_id").isNotNull() & (id_bucket(F.col("label_id"), 3) != 1)
    )
    chosen = (
        thinned(usable, F.col("label_id"), sample)
        .groupBy("label_id")
        .agg(F.min("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [np.array(terms(t), "<i4").tobytes() for t in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    rows = (
        documents.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")
        .mapInArrow(of_batch, "doc_id string, toxic int, terms binary")
        .groupBy("doc_id", "toxic")
        .agg(F.min("terms").alias("terms"))
        .collect()
    )
    rows.sort(key=lambda r: (len(r["doc_id"]), r["doc_id"], bytes(r["terms"])))
    return fit([(np.frombuffer(bytes(r["terms"]), "<i4"), r["toxic"]) for r in rows])


def score_column(machine: Machine, documents: DataFrame, text: Column) -> Column:
    """The machine's score of a text column, 0 to 1; a null text scores as an empty one."""
    sent = documents.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        known: dict[str, tuple[int, ...]] = {}

        def of_text(t: str | None) -> float:
            if len(known) > KEPT:
                known.clear()
            rows = set()
            for w in set(_WORD.findall((t or "").lower())):
                at = known.get(w)
                if at is None:
                    at = tuple(m.place[b] for b in _buckets(w) if b in m.place)
                    if len(w) <= KEPT_LETTERS:
                        known[w] = at
                if at:
                    rows.update(at)
            return m.score(np.array(sorted(rows), int))

        return pd.Series([of_text(t) for t in texts], dtype="float64")

    return score(text.cast("string"))


def toxicity_report(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted, a row per document.

    Null and empty texts get the machine's bias. Repeated rows score alike; an
    empty table gives no rows; texts of any length are scored whole; no other column is
    looked at, whatever its name.
    """
    return documents.select(
        "doc_id",
        (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"),
        score_column(machine, documents, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_civil(documents: DataFrame, machine: Machine) -> DataFrame:
    """The documents that score under the threshold, columns as they came.

    Null and empty texts get the machine's bias as their score. Repeated rows are
    judged alike; an empty table gives no rows.
    """
    return documents.where(score_column(machine, documents, F.col("text")) < THRESHOLD)
