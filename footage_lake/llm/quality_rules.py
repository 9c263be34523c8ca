"""Quality rules: word statistics per document and a learned decision list.

Everything on the data is DataFrame functions. The list itself is learned by
sequential covering on a bounded sample of labelled statistics (``SAMPLE``
rows of a few numbers each, fetched to the driver) and comes back as one
ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footage_lake.llm.common import WORD_CHAR, let, thinned, words_of

#: Labelled documents that a list is learned from, at most.
SAMPLE = 6000
#: Words of a window whose second occurrence counts as repetition.
WINDOW = 8
#: Character classes that are counted.
SYMBOLS = "#*$%&|<>"
UPPER = "A-Z"
DIGITS = "0-9"
MARKS = "!?"


def _count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]++", "")).cast("long")


def _repeated(words: Column, n: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
            kept = F.filter(s, lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(pairs, places),
            start,
            lambda acc, at: F.struct(
                (acc["sum"] + F.least(F.lit(WINDOW), at - acc["last"])).cast("long").alias("sum"), at.alias("last")
            ),
            lambda acc: acc["sum"],
        )

    # single look-ups: slice() would walk the whole array for each window
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), window)
    found = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )
    return F.when(n > WINDOW, found).otherwise(F.lit(0).cast("long"))


def text_statistics(text: Column) -> Column:
    """A struct of counts over the whole text; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w, n).alias("n_repeat_words"),
        )

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(WORD_CHAR)))
        return F.struct(
            let(words_of(t), of_words).alias("w"),
            _count_of(t, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            _count_of(t, UPPER).alias("n_upper"),
            _count_of(t, DIGITS).alias("n_digits"),
            _count_of(t, MARKS).alias("n_marks"),
        )

    return let(text, of_text)


def features(n_words: Column, s: Column) -> dict[str, Column]:
    """Named ratios that the rules set thresholds on."""
    words = F.greatest(n_words, F.lit(1))
    chars = F.greatest(s["w"]["word_chars"], F.lit(1))
    return {
        "words": n_words.cast("double"),
        "word_length": s["w"]["word_chars"] / words,
        "symbols": s["n_symbols"] / chars,
        "upper": s["n_upper"] / chars,
        "digits": s["n_digits"] / chars,
        "marks": s["n_marks"] / chars,
        "dup_lines": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeated": s["w"]["n_repeat_words"] / words,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, none: the document is kept."""

    rules: list[list[Test]] = field(default_factory=list)

    def column(self, cols: dict[str, Column]) -> Column:
        """The list as CASE WHEN ... THEN false ... ELSE true."""
        out = None
        for rule in self.rules:
            cond = F.lit(True)
            for t in rule:
                cond = cond & ((cols[t.feature] > t.bound) if t.above else (cols[t.feature] <= t.bound))
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


class _Sample:
    """Labelled statistics on the driver: a row of numbers each, at most SAMPLE rows."""

    def __init__(self, values: np.ndarray, bad: np.ndarray, names: list[str]) -> None:
        self.values, self.bad, self.names = values, bad, names

    def where(self, rows: np.ndarray) -> _Sample:
        return _Sample(self.values[rows], self.bad[rows], self.names)

    def holds(self, test: Test) -> np.ndarray:
        x = self.values[:, self.names.index(test.feature)]
        return x > test.bound if test.above else x <= test.bound

    def covered(self, rule: list[Test]) -> np.ndarray:
        rows = np.ones(len(self.bad), bool)
        for test in rule:
            rows &= self.holds(test)
        return rows

    def counts(self, rule: list[Test]) -> tuple[int, int]:
        bad = self.bad[self.covered(rule)]
        return int(bad.sum()), int((~bad).sum())

    def best(self) -> Test | None:
        """The test of highest information gain over all features and midpoints; ties: the first."""
        base = math.log2(self.bad.mean())
        found, gain = None, 1e-9
        for k, name in enumerate(self.names):
            order = np.argsort(self.values[:, k], kind="stable")
            x, bad = self.values[order, k], np.cumsum(self.bad[order])
            cut = np.flatnonzero(x[1:] > x[:-1])
            if not len(cut):
                continue
            low_bad, low = bad[cut].astype(float), cut + 1.0
            for above, p, n in ((True, bad[-1] - low_bad, len(x) - low), (False, low_bad, low)):
                g = p * (np.log2(np.maximum(p, 1e-9) / n) - base)
                at = int(np.argmax(g))
                if g[at] > gain:
                    found, gain = Test(name, above, float((x[cut[at]] + x[cut[at] + 1]) / 2)), float(g[at])
        return found


def _grow(rows: _Sample) -> list[Test]:
    """Add the best test until no good row is covered, four tests at most."""
    rule: list[Test] = []
    while len(rule) < 4 and 0 < rows.bad.sum() < len(rows.bad):
        test = rows.best()
        if test is None:
            break
        rule.append(test)
        rows = rows.where(rows.holds(test))
    return rule


def _prune(rule: list[Test], rows: _Sample) -> list[Test]:
    """Drop last tests while the worth on rows kept aside, (p - n) / (p + n), does not fall."""

    def worth(r: list[Test]) -> float:
        p, n = rows.counts(r)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(rows: list[tuple[dict[str, float], int]], precision: float = 0.9, least: int = 3) -> DecisionList:
    """Sequential covering of the label-0 rows.

    Two thirds grow rules, the rest prune them. A rule enters the list while it
    covers ``least`` bad rows and ``precision`` of what it covers is bad. No rows
    or a single class give the empty list, which keeps everything.
    """
    found = DecisionList()
    if not rows:
        return found
    names = sorted(rows[0][0])
    left = _Sample(np.array([[r[k] for k in names] for r, _ in rows]), np.array([y == 0 for _, y in rows]), names)
    while 0 < left.bad.sum() < len(left.bad):
        grow = np.arange(len(left.bad)) % 3 < 2
        if not 0 < left.bad[grow].sum():
            break
        rule = _prune(_grow(left.where(grow)), left.where(~grow))
        p, n = left.counts(rule)
        if not rule or p < least or p < precision * (p + n):
            break
        found.rules.append(rule)
        left = left.where(~left.covered(rule))
    return found


def learn_rules(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Fit the list on up to ``sample`` labelled documents, chosen by a hash of the id.

    Labels of null and ids without a document are left out. Of labels that repeat an
    id the least counts, of documents that do the one of the least statistics, so
    that the sample keeps its bound.
    """
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isNotNull() & F.col("label_id").isNotNull()
    )
    chosen = (
        thinned(usable, F.col("label_id"), sample)
        .groupBy("label_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    stats = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "quality", text_statistics(F.col("text")).alias("s"))
    )
    cols = features(F.col("s.w.n_words"), F.col("s"))
    least = F.min(F.struct(*[c.alias(k) for k, c in cols.items()])).alias("least")
    rows = stats.groupBy("doc_id", "quality").agg(least).orderBy("doc_id").collect()
    return learn([({k: float(r["least"][k]) for k in cols}, r["quality"]) for r in rows])


def quality_columns(text: Column, rules: DecisionList) -> Column:
    """Struct of the counts, ``base_failed`` and ``kept`` for one text column."""

    def verdict(s: Column) -> Column:
        n = s["w"]["n_words"]
        failed = (n < 20) | (100 * s["w"]["n_repeat_words"] > 30 * n)
        return F.struct(
            n.alias("n_words"),
            s["w"]["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            s["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.when(failed, F.lit(False)).otherwise(rules.column(features(n, s))).alias("kept"),
        )

    return let(text_statistics(text), verdict)


def quality_report(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per document: counts, base verdict, verdict of the list.

    Null and empty texts have no words and fail the base test; repeated rows
    are judged alike, texts of any length whole; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    return documents.select("doc_id", quality_columns(F.col("text"), rules).alias("q")).select("doc_id", "q.*")


def keep_good(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that neither the base test nor the list rejects, columns as they came.

    Null and empty texts fail the base test and go. Repeated rows are judged alike;
    an empty table gives no rows.
    """
    return documents.where(quality_columns(F.col("text"), rules)["kept"])
