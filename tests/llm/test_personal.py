"""Personal data: base spans by the plain patterns, votes and reliabilities by hand."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from footage_lake.llm import personal

SF = "/root/testdata/sf0.01"


def brute_base(text):
    text = text or ""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        total = 0
        for k, x in enumerate(reversed(d)):
            x = x * 2 if k % 2 else x
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in re.finditer(p, text) if ok(m[0])]


def said(spans):
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


ODD = [
    (None, "a@b.c"), (2, None), (2, None), (3, ""), (4, "x@y@z.com .@a.b a@b..c a@-.- @a.b"), (5, "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 00000.1.1.1 1.2.3"), (6, "4111 1111-1111 1111 0 4111111111111111 - 1"),
    (7, "+1 (377) 555-0271. +1(((( +12345678901234567 ++49 30 1234567-"), (8, "é漢 a.b@c.de 😀 10.0.0.1 😀" * 50), (9, "9" * 5000 + "." * 10 + "1." * 5000),
]


def test_base_spans_by_the_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    every = docs.unionByName(spark.createDataFrame([(i, t) for i, t in ODD], "doc_id bigint, text string"))
    rows = personal.personal_report(every, personal.learn(every)).collect()
    want = Counter()
    for r in every.collect():
        base = brute_base(r["text"])
        n = Counter(k for k, _, _ in base)
        want[(r["doc_id"], *(n[k] for k in personal.BASE), hashlib.sha256(said(base).encode()).hexdigest(), said(base))] += 1
    got = Counter((r["doc_id"], *(r[f"n_{k}"] for k in personal.BASE), r["base_sha256"], ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in personal.BASE)) for r in rows)
    assert got == want and sum(n * sum(k[1:5]) for k, n in want.items()) > 100
    kinds = Counter(x.split(":")[0] for r in rows for x in r["spans"].split(",") if x)
    assert all(kinds[k] == 0 for k in ("card_like", "ip_like"))
    assert personal.personal_report(every.where("false"), personal.learn(every.where("false"))).count() == 0


def test_base_spans_of_random_strings():
    rng = random.Random(5)
    for alphabet in ("a.@-+_", "01.25", "0149 -", "+12() .-3", "a@.1+ (9)-é"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert personal.candidates(text)[0] == brute_base(text), text


@pytest.mark.parametrize("text", ["a" * 500_000, "1" * 500_000, "+1" * 250_000, "1." * 250_000, "a@" * 250_000, "+1 (" * 120_000, "Dr. A" * 100_000, "a at b dot " * 50_000, "ab:" * 160_000, "DE12 3456 " * 50_000, "1 " * 250_000])
def test_long_texts_take_linear_time(text):
    start = time.process_time()
    base, more = personal.candidates(text)
    for f in (base + more)[:1000]:
        personal.votes(text, f)
    assert time.process_time() - start < 5


PLANTED = [
    ("Please write to jane [at] mail [dot] org for details", "jane [at] mail [dot] org", "email_spelled"),
    ("My email is jane.doe at mail dot com thanks", "jane.doe at mail dot com", "email_spelled"),
    ("Bank account IBAN: DE89 3704 0044 0532 0130 00 today", "DE89 3704 0044 0532 0130 00", "account"),
    ("His SSN: 123-45-6789 was typed", "123-45-6789", "national_id"),
    ("Tel: (030) 1234 5678 after nine", "(030) 1234 5678", "local_phone"),
    ("She was born 12.03.1984 in a village", "12.03.1984", "birth_date"),
    ("We met Dr. Peter Miller there", "Peter Miller", "name"),
]
CLEAN = ["Order no 123-45-0000 shipped", "see section 12.03.2001 of the table", "part 4811 2233 4455 of lot", "version 300.2.1.999 released", "number 9807915762804490 in the list", "rows 4811 2233 4455 and 123-45-6789 of 12.03.2001", "Dr. No was shown", "we look at example.com", "AB12 3456 7890 1234 is a serial"]


def test_added_spans(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(PLANTED)] + [(100 + k, t) for k, t in enumerate(CLEAN)] + [(200, "a@b.com " * 40)]
    frame = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id int, text string, spans int")
    finder = personal.learn(frame)
    found = {r["doc_id"]: r["spans"] for r in personal.personal_report(frame, finder).collect()}
    for k, (text, span, kind) in enumerate(PLANTED):
        assert f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" in found[k].split(","), text
    assert all(found[100 + k] == "" for k in range(len(CLEAN))), found
    hidden = {r["doc_id"]: r["text"] for r in personal.redact(frame, finder).collect()}
    assert hidden[3] == "His SSN: [PERSONAL] was typed" and hidden[100] == CLEAN[0]


def test_added_spans_meet_no_other():
    finder = personal.learned(np.zeros(0, np.int64), np.zeros(0, np.int64))
    scorer = personal._Scorer(finder)
    rng = random.Random(8)
    parts = ["SSN 123-45-6789", "+1 (377) 555-0271", "tel 0377 555 0271", "Dr. Anna Smith", "born 1.2.1990", "4111 1111 1111 1111", "x [at] y [dot] com", "a@b.com"]
    for _ in range(300):
        text = rng.choice(["", " ", "-", ": "]).join(rng.choice(parts) for _ in range(5))
        base, spans = scorer.spans(text)
        assert spans[: len(base)] == base
        for k, a, e in spans[len(base) :]:
            assert all(e <= b or f <= a for x in spans if x != (k, a, e) for _, b, f in [x])
        assert personal.masked(text, []) == text


def test_reliabilities_of_planted_labelers():
    rng = np.random.default_rng(4)
    n = 20_000
    truth = rng.random(n) < 0.3
    right, says = [0.95, 0.8, 0.7, 0.6, 0.9], [0.9, 0.6, 0.5, 0.8, 0.4]
    cast = np.zeros((n, 5), np.int64)
    for j in range(5):
        vote = np.where(rng.random(n) < right[j], truth, ~truth)
        cast[:, j] = np.where(rng.random(n) < says[j], np.where(vote, 1, -1), 0)
    rows, counts = np.unique(cast, axis=0, return_counts=True)
    model = personal.estimated(rows, counts.astype(float))
    assert model.share == pytest.approx(0.3, abs=0.03)
    for j in range(5):
        assert model.votes[1, j, 2] / (model.votes[1, j, 2] + model.votes[1, j, 0]) == pytest.approx(right[j], abs=0.05)
    likely = model.likelihood(cast)
    best = (cast == 1).sum(axis=1) > (cast == -1).sum(axis=1)
    assert ((likely > 0.5) == truth).mean() > (best == truth).mean()
    weights = personal.regressed(personal.features(rows, np.zeros((len(rows), 4))), model.likelihood(rows), counts.astype(float))
    score = personal.features(cast, np.zeros((n, 4))) @ weights
    assert ((score > 0) == truth).mean() > 0.93


def test_patterns_open_to_what_was_cast():
    seen = np.arange(len(personal.KINDS) * personal.PATTERNS)
    kind, cast, marks = personal.opened(seen)
    back = kind
    for j in range(cast.shape[1]):
        back = 3 * back + cast[:, j] + 1
    for j in range(marks.shape[1]):
        back = 2 * back + marks[:, j]
    assert (back == seen).all() and kind.max() == len(personal.KINDS) - 1
