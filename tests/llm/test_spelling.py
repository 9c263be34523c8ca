"""Spelling variants against a walk over all edits."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footage_lake.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len, reverse=True)
    k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def brute_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    """Near words by making each deletion of each word: two near words share one of these or are one themselves."""
    by_gap: dict[str, set] = {}
    for w in words:
        for g in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_gap.setdefault(g, set()).add(w)
    near = {w: set() for w in words}
    for group in by_gap.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_variants_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "größe Größe größe gröse"), (7, None), (7, ""), (8, "aaaaab " * 5000 + "aaaab " * 2000 + "aaaaaa× " * 3), (8, "x" * 3000 + " " + "x" * 2999), (8, "x" * 3000), (8, "x" * 3000), (9, "x" * 2999), (9, "x" * 2999), (9, "İstanbul straße STRASSE ퟿漢字漢字漢")]
    made = spark.createDataFrame([(i, t, "x", 1) for i, t in odd], "doc_id bigint, text string, word string, n int")
    every = docs.select("doc_id", "text").unionByName(made.select("doc_id", "text"))
    want = brute_variants(brute_words([tuple(r) for r in every.collect()]))
    assert len(want) > 1000 and sum(x[0] is not None for x in want.values()) > 20
    assert got(spelling.variant_report(every)) == want
    assert got(spelling.variant_report(made)) == brute_variants(brute_words(odd))
    assert spelling.variant_report(made.where("false")).count() == 0


def test_a_deleted_letter_by_the_hash(spark):
    runs = [f"letter{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(k, " ".join(runs)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    found = {r["word"]: r["n"] for r in spelling.word_counts(frame).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert sum(found.values()) == 4000 and len(found) > 100 and {w: n for w, n in found.items() if n >= 3} == brute_words(rows)


@pytest.mark.parametrize("chars, part", [(64, 3), (1000, 10_000), (1 << 17, 7)])
def test_near_pairs_once_in_small_parts(spark, chars, part):
    rng = random.Random(chars)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(2, 8))) for _ in range(500)})
    frame = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n bigint")
    rows = Counter(tuple(r) for r in spelling.near_words(frame, chars, part).collect())
    assert rows == Counter((a, b, k) for a in words for k, b in enumerate(words) if one_edit(a, b))


def test_index_searches_both_ways():
    rng = random.Random(3)
    for _ in range(100):
        letters = "abé"[: rng.randint(1, 3)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 60))})
        held = sorted(rng.sample(words, rng.randint(1, len(words))))
        index = spelling.BiIndex(held)
        for longer in (False, True):
            found = set()
            for side in (0, 1):
                query, number = index.one_edit(words, side, longer)
                found |= {(words[q], held[k]) for q, k in zip(query.tolist(), number.tolist(), strict=True)}
            assert found == {(a, b) for a in words for b in held if one_edit(a, b) and (longer or len(b) <= len(a))}


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        text = rng.integers(0, 3, n)
        assert spelling.suffix_order(text).tolist() == sorted(range(n), key=lambda k: text[k:].tolist())


def test_chains_of_forms(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb", "aabbbbbb", "abbbbbbb"]
    words = {w: 3 * 2**k for k, w in enumerate(chain)} | {"zzzzz": 3, "zzzzy": 5, "yyyyy": 4, "yyyyx": 8, "yyyyw": 8}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = got(spelling.variants(frame))
    assert found == brute_variants(words)
    assert found["aaaaaaaa"][1] == "abbbbbbb" and found["zzzzz"][0] is None and found["yyyyy"][0] == "yyyyw"
