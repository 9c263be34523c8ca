"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Four base kinds are found by fixed patterns and always stay. Wider patterns give further
candidates: spelled-out addresses, account numbers, national ids, local phone numbers,
names, dates of birth, long host addresses, numbers that fail a base test. Five labelers
vote on each candidate (format and check digits, gazetteer, context words, neighbours,
shape), each for, against or not at all. How often each pattern of votes occurs is
counted over all documents; from these counts, expectation-maximisation estimates per kind
how reliable each labeler is and how likely each pattern is personal data. A logistic
regression per kind, trained on these likelihoods, scores the spans.

The patterns that votes and marks can make are ``PATTERNS`` per kind at most, so what
comes to the driver is bounded whatever the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, and the others.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "email_spelled", "ip_long", "card_like", "ip_like", "account", "national_id", "local_phone", "birth_date", "name"]
LABELERS = ["format", "gazetteer", "context", "neighbours", "shape"]
MARKS = ["after_colon", "own_line", "long", "capital_before"]
PATTERNS = 3 ** len(LABELERS) * 2 ** len(MARKS)
#: Score from which a candidate that is no base span is a span.
THRESHOLD = 0.5
MARK = "[PERSONAL]"
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 24

# Gazetteers and context words.
TOP_DOMAINS = set("com org net edu gov info biz io co us uk de fr es it nl be ch at pl pt se no dk fi ie eu ca au nz jp cn in br mx ar ru ua cz gr tr za".split())
ACCOUNTS = dict(AT=20, BE=16, CH=21, CZ=24, DE=22, DK=18, ES=24, FI=18, FR=27, GB=22, GR=27, IE=22, IT=27, LU=20, NL=18, NO=15, PL=28, PT=25, SE=24)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-8]|6011|65|62")
GIVEN = set(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen"
    " peter paul mark daniel anna maria laura emma julia sophie marie pierre jean louis claire hans karl klaus heinz ursula monika petra sabine"
    " jose juan carlos luis ana carmen pedro miguel isabel antonio francisco giulia marco luca".split()
)
CONTEXT = {
    "email": "email mail e-mail contact write courriel correo".split(),
    "ip": "ip host server address client login connection logged adresse".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta kreditkarte".split(),
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon handy telefono teléfono téléphone".split(),
    "account": "iban account bank transfer konto compte cuenta".split(),
    "national_id": "ssn social security national identity id tax".split(),
    "birth_date": "born birth birthday dob geboren geburtsdatum né née nacido nacida".split(),
    "name": "name mr mrs ms dr herr frau monsieur madame señor señora signed dear called".split(),
}
AGAINST = set("isbn issn doi order invoice version release build serial sku part ref reference page pages rfc section chapter item model article figure table lot tracking commit port".split())
_OF = {"email_spelled": "email", "ip_long": "ip", "ip_like": "ip", "card_like": "card", "local_phone": "phone"}
CONTEXT = {k: set(CONTEXT[_OF.get(k, k)]) for k in KINDS}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT, _DOT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?)", r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)"
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}})+|\x20(?:at|AT)\x20[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+)"
)
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])")
_DATE = re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z/-])")
_TITLES = ("Mr", "Ms", "Dr", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor", "name is ", "Name: ", "ich heiße ", "m'appelle ", "me llamo ")
_NAME = re.compile(r"(?<![^\W_])(?:(?:Mrs?|Ms|Dr)\.?|Herr|Frau|Monsieur|Madame|Señora?|[Mm]y name is|Name:|ich heiße|m'appelle|me llamo)\x20([A-ZÀ-Þ][\w'-]{1,30}(?:\x20[A-ZÀ-Þ][\w'-]{1,30}){0,2})")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

Found = tuple[str, int, int]  # kind, start, end


# ---------------------------------------------------------------- base spans


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what stands before each ``@`` with a domain behind it, not before the end of the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _low_parts(s: str) -> bool:
    """Whether all parts between dots are at most 255."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def _meets(taken: list[tuple[int, int]], a: int, e: int) -> bool:
    """Whether a span overlaps one of ``taken``, which are disjoint and sorted."""
    at = bisect_left(taken, (e, 0))
    return at > 0 and taken[at - 1][1] > a


def candidates(text: str) -> tuple[list[Found], list[Found]]:
    """(base spans by kind, then start; other candidates, none of which overlaps a base span, by kind)."""
    base: list[Found] = []
    more: list[Found] = []
    if "@" in text:
        base += (("email", a, e) for a, e in emails(text))
    if _HAS_DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                (base if _low_parts(m[0]) else more).append(("ip" if _low_parts(m[0]) else "ip_like", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19:
                whole = len(digits) >= 16 and luhn(digits)
                (base if whole else more).append(("card" if whole else "card_like", m.start(), m.end()))
        if "+" in text:
            base += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
        if ":" in text:
            more += (("ip_long", m.start(), m.end()) for m in _LONG_IP.finditer(text))
        more += (("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text))
        if "-" in text:
            more += (("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text))
        more += (("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 12)
        more += (("birth_date", m.start(), m.end()) for m in _DATE.finditer(text))
    if any(w in text for w in ("at]", "at)", "at}", " dot ", "AT]", "AT)", "AT}", " DOT ", "at ]", "at )", "AT ]", "AT )")):
        more += (("email_spelled", m.start(), m.end()) for m in _SPELLED.finditer(text))
    if any(w in text for w in _TITLES):
        more += (("name", m.start(1), m.end(1)) for m in _NAME.finditer(text))
    if base and more:
        taken = _united((a, e) for _, a, e in base)
        more = [f for f in more if not _meets(taken, f[1], f[2])]
    return base, more


_HAS_DIGIT = re.compile("[0-9]")


# ---------------------------------------------------------------- votes


def _account_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _format_vote(kind: str, s: str) -> int:
    """Check digits and value ranges."""
    if kind in ("card", "card_like"):
        return 1 if luhn(_digits(s)) else -1
    if kind in ("ip", "ip_like"):
        return 1 if _low_parts(s) else -1
    if kind == "account":
        return 1 if _account_holds(s) else -1
    if kind == "national_id":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "birth_date":
        a, b, *_ = (int(x) for x in re.split("[./-]", s[5:] if s[4] == "-" else s))
        return 1 if 1 <= min(a, b) <= 12 and max(a, b) <= 31 and min(a, b) else -1
    if kind == "phone":
        return 1 if len(_digits(s)) >= 10 else 0
    if kind in ("email", "email_spelled"):
        return 1 if s[-2:].isalpha() else -1
    return 1 if kind == "ip_long" else 0


def _gazetteer_vote(kind: str, s: str) -> int:
    if kind in ("email", "email_spelled"):
        return 1 if _WORD.findall(s)[-1:] and _WORD.findall(s)[-1].lower() in TOP_DOMAINS else -1
    if kind in ("card", "card_like"):
        return 1 if ISSUERS.match(_digits(s)) else 0
    if kind == "ip":
        a, b = (int(x.lstrip("0") or "0") for x in s.split(".")[:2])
        return -1 if a in (0, 10, 127) or a >= 224 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else 0
    if kind == "phone":
        return -1 if s[1] == "0" else 1
    if kind == "account":
        return 1 if ACCOUNTS.get(s[:2]) == len(s.replace(" ", "")) else -1
    if kind == "name":
        return 1 if s.split()[0].lower() in GIVEN else 0
    if kind == "local_phone":
        return 1 if s.lstrip("(")[0] == "0" else 0
    return 0


def _context_vote(kind: str, around: set[str]) -> int:
    return 1 if around & CONTEXT[kind] else -1 if around & AGAINST else 0


def _shape_vote(kind: str, s: str) -> int:
    """Usual groups for, one repeated digit against."""
    digits = _digits(s)
    if len(digits) > 4 and len(set(digits)) == 1:
        return -1
    if kind in ("card", "card_like"):
        return 1 if re.fullmatch(r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[0-9]{3}([\x20-])[0-9]{6}\2[0-9]{5}", s) else 0
    if kind in ("phone", "local_phone"):
        return 1 if "(" in s or sum(s.count(c) for c in " .-") >= 2 else 0
    if kind == "account":
        return 1 if re.fullmatch(r"[A-Z0-9]{4}(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?", s) else 0
    if kind == "name":
        return 1 if " " in s else 0
    return 0


def votes(text: str, found: Found) -> int:
    """The pattern of a candidate: its kind, the labelers' votes, its marks, as one number."""
    kind, a, e = found
    s, before, after = text[a:e], text[max(0, a - BEFORE) : a], text[e : e + AFTER]
    around = {w.lower() for w in _WORD.findall(before) + _WORD.findall(after)}
    beside = before[-1:] + after[:1]
    cast = [
        _format_vote(kind, s), _gazetteer_vote(kind, s), _context_vote(kind, around), -1 if any(c.isalnum() or c == "_" for c in beside) else 0, _shape_vote(kind, s),
    ]
    marks = [before.rstrip(" ")[-1:] in (":", "="), before[-1:] in ("", "\n") and after[:1] in ("", "\n"), e - a > 24, before.split(" ")[-2:-1] != [] and before.split(" ")[-2][:1].isupper()]
    out = KINDS.index(kind)
    for v in cast:
        out = 3 * out + v + 1
    for m in marks:
        out = 2 * out + bool(m)
    return out


def opened(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (-1, 0, 1; a column per labeler) and marks (0, 1) of patterns."""
    rest = patterns.astype(np.int64).copy()
    marks = np.zeros((len(rest), len(MARKS)), np.int64)
    for k in reversed(range(len(MARKS))):
        rest, marks[:, k] = rest // 2, rest % 2
    cast = np.zeros((len(rest), len(LABELERS)), np.int64)
    for k in reversed(range(len(LABELERS))):
        rest, cast[:, k] = rest // 3, rest % 3 - 1
    return rest, cast, marks


# ---------------------------------------------------------------- learning


def pattern_counts(documents: DataFrame) -> DataFrame:
    """(pattern, n): how many candidates of all documents have each pattern."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    base, more = candidates(text)
                    seen.update(votes(text, f) for f in base + more)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int32()), pa.array(seen.values(), pa.int64())], ["pattern", "n"])

    texts = documents.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(of_task, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


#: What labelers do before any count: shares of votes against, none, for; on other spans and on personal data. Counts as ``PRIOR`` candidates.
VOTES_BEFORE, PRIOR = np.array([[0.45, 0.5, 0.05], [0.05, 0.5, 0.45]]), 40.0
#: The share of personal data before any count: of the other kinds so little that one vote for it is not enough.
SHARE_BEFORE = {k: 0.5 if k in BASE else 0.05 for k in KINDS}


@dataclass
class Reliability:
    """Of one kind: the share of personal data, and per class and labeler the shares of votes against, none, for."""

    share: float
    votes: np.ndarray  # class x labeler x vote

    def likelihood(self, cast: np.ndarray) -> np.ndarray:
        """How likely patterns of votes are personal data."""
        at = cast + 1
        log = np.log([1 - self.share, self.share])[:, None] + sum(np.log(self.votes[:, j, at[:, j]]) for j in range(at.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def estimated(cast: np.ndarray, n: np.ndarray, share_before: float = 0.5, rounds: int = 200) -> Reliability:
    """Expectation-maximisation over patterns of votes and their counts; labelers are independent within a class.

    The votes expected before any count keep the classes in their order and few candidates
    from deciding. Ends when no share changes by more than 1e-9.
    """
    prior = np.repeat(VOTES_BEFORE[:, None, :], cast.shape[1], axis=1)
    model = Reliability(share_before, prior)
    for _ in range(rounds):
        likely = model.likelihood(cast)
        weight = np.stack([(1 - likely) * n, likely * n])
        seen = np.stack([[np.bincount(cast[:, j] + 1, weights=w, minlength=3) for j in range(cast.shape[1])] for w in weight])
        shares = (seen + PRIOR * prior) / (seen + PRIOR * prior).sum(axis=2, keepdims=True)
        share = float((weight[1].sum() + PRIOR * share_before) / (n.sum() + PRIOR))
        done = max(np.abs(shares - model.votes).max(), abs(share - model.share)) < 1e-9
        model = Reliability(share, shares)
        if done:
            break
    return model


def features(cast: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """One, then a column for votes for and one for votes against of each labeler, then the marks."""
    return np.concatenate([np.ones((len(cast), 1)), cast == 1, cast == -1, marks], axis=1).astype(float)


#: Weights before any candidate: votes for and against; a kind's candidates count as ``EFFECT`` together at most.
WEIGHTS_BEFORE = np.array([-2.5, *[1.8] * len(LABELERS), *[-2.0] * len(LABELERS), *[0.0] * len(MARKS)])
EFFECT = 5000.0


def regressed(x: np.ndarray, likely: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression to likelihoods by Newton steps, drawn to ``WEIGHTS_BEFORE``."""
    weight = n * min(1.0, EFFECT / n.sum())
    w = WEIGHTS_BEFORE.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (likely - p)) - (w - WEIGHTS_BEFORE)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 4.0 / np.abs(step).max(initial=1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Finder:
    """Per kind the labelers' reliabilities and the classifier's weights."""

    reliability: dict[str, Reliability]
    weights: np.ndarray

    def scores(self, patterns: np.ndarray) -> np.ndarray:
        kind, cast, marks = opened(patterns)
        return 1 / (1 + np.exp(-np.clip((features(cast, marks) * self.weights[kind]).sum(axis=1), -30, 30)))


def learned(patterns: np.ndarray, n: np.ndarray) -> Finder:
    """A finder from the counts of patterns; a kind without candidates has the weights before any."""
    out = Finder({}, np.tile(WEIGHTS_BEFORE, (len(KINDS), 1)))
    kind, cast, marks = opened(patterns)
    for k, name in enumerate(KINDS):
        rows = kind == k
        if rows.any():
            own = out.reliability[name] = estimated(cast[rows], n[rows].astype(float), SHARE_BEFORE[name])
            out.weights[k] = regressed(features(cast[rows], marks[rows]), own.likelihood(cast[rows]), n[rows].astype(float))
    return out


def learn(documents: DataFrame) -> Finder:
    """A finder from all candidates of all documents; null and empty texts and empty tables have none."""
    rows = sorted((r["pattern"], r["n"]) for r in pattern_counts(documents).collect())
    return learned(np.array([p for p, _ in rows], np.int64), np.array([n for _, n in rows], np.int64))


# ---------------------------------------------------------------- finding


class _Scorer:
    """A worker's finder, which scores each pattern once."""

    def __init__(self, finder: Finder) -> None:
        self.finder, self.known = finder, {}

    def score(self, pattern: int) -> float:
        if pattern not in self.known:
            self.known[pattern] = float(self.finder.scores(np.array([pattern]))[0])
        return self.known[pattern]

    def spans(self, text: str) -> tuple[list[Found], list[Found]]:
        """(base spans, all spans by kind, then start). A further span overlaps no base span and none before it, likelier ones first."""
        base, more = candidates(text)
        if not more:
            return base, base
        taken: list[tuple[int, int]] = []
        added = []
        for score, found in sorted((-self.score(votes(text, f)), f) for f in more):
            if -score >= THRESHOLD and not _meets(taken, found[1], found[2]):
                insort(taken, found[1:])
                added.append(found)
        return base, base + sorted(added, key=lambda f: (KINDS.index(f[0]), f[1]))


def personal_spans(documents: DataFrame, finder: Finder) -> DataFrame:
    """doc_id and per document its spans, an array of (kind, start, end, base), by kind, then start.

    Starts and ends are code points, ends exclusive. Null and empty texts have none.
    """
    sent = documents.sparkSession.sparkContext.broadcast(finder)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, spans = scorer.spans(text or "")
                rows.append([{"kind": k, "start": a, "end": e, "base": i < len(base)} for i, (k, a, e) in enumerate(spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(of_batch, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def personal_report(documents: DataFrame, finder: Finder) -> DataFrame:
    """doc_id, counts of the base spans, their digest and all spans, a row per document.

    Null and empty texts have no spans and the digest of the empty string. Texts of any
    length are read whole, in time linear in them. Repeated rows are reported as often as
    they come; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    said = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return personal_spans(documents, finder).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def masked(text: str, spans: list[Found], mark: str = MARK) -> str:
    """The text with its spans, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, e in _united((a, e) for _, a, e in spans):
        out += [text[at:a], mark]
        at = e
    return "".join(out) + text[at:]


def redact(documents: DataFrame, finder: Finder) -> DataFrame:
    """The documents with personal data in ``text`` masked; all rows and columns stay, null texts stay null.

    ``n_chars``, where present, follows the new text. An empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(finder)

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        scorer = _Scorer(sent.value)
        return pd.Series([None if t is None else masked(t, scorer.spans(t)[1]) for t in texts], dtype="object")

    out = documents.withColumn("text", hidden(F.col("text").cast("string")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
