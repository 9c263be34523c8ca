"""Corpus operators against plain brute-force versions, and their defined edge cases."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from footage_lake.llm import bpe, fingerprint, hmm, main_text, packing, quality_rules, secrets, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(None, "a b"), (3, None), (3, None), (4, ""), (5, " \t\n"), (7, "é \x00 漢字 <|endoftext|> x" * 40), (8, "token = abcdef123 " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows and extra columns named like results."""
    rows = [(i, t, 1, "x", True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, kept string, sig boolean")


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def empty(frame):
    return frame.where("false")


# ---- secrets


def brute_base(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"""((?:{word}|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def said(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in spans)


def test_secret_base_spans(spark, docs, odd):
    made = ['Token:"abc" secret = "token:abcdef"', "x" + "AKIA" * 9, "pASSWORD = 'é' api_key:=1234567", "0" * 23 + " " + "f" * 24 + "G"]
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(made)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    want = Counter((i, hashlib.sha256(said(brute_base(t)).encode()).hexdigest()) for i, t in texts(every))
    rows = secrets.secret_report(every).collect()
    assert Counter((r["doc_id"], r["base_sha256"]) for r in rows) == want
    for r in rows:
        counts = Counter(x.split(":")[0] for x in r["spans"].split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
    assert secrets.secret_report(empty(docs)).count() == 0


def test_window_entropy_is_the_best_window(spark):
    words = ["a", "abcabcabc", "Zm9vYmFyQmF6MTIzNDU2Nzg5MA==", "x" * 700 + "Zm9vYmFyQmF6MTIz" + "y" * 300, "abcdefghijklmnopqrst" * 30]
    h = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
    got = spark.createDataFrame([(w,) for w in words], "w string").select(secrets.window_entropy(F.col("w"), 20)).collect()
    for (x,), w in zip(got, words, strict=True):
        assert x == pytest.approx(max(h(w[i : i + 20]) for i in range(max(1, len(w) - 19))), abs=1e-9)


def test_entropy_spans_and_allow_list(spark):
    found = "key Zk93Lx72QmPa81TvYw0dRsBn45 and DEADBEEF98213746AB90CDEF77"
    calm = "550e8400-e29b-41d4-a716-446655440000 4785380592391135 thewordwithoutentropyatall CamelCaseWordsWithoutDigitsInside"
    rows = secrets.secret_report(spark.createDataFrame([(1, found), (2, calm)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert rows[0]["spans"] == "entropy:4:30,entropy:35:61" and rows[1]["spans"] == ""
    masked = secrets.redact(spark.createDataFrame([(1, found, 9), (2, calm, 9), (3, None, 9)], "doc_id int, text string, n_chars bigint")).orderBy("doc_id").collect()
    assert masked[0]["text"] == "key [SECRET] and [SECRET]" and masked[0]["n_chars"] == len(masked[0]["text"])
    assert masked[1]["text"] == calm and masked[2]["text"] is None


def brute_spans(text):
    """All spans, by Python's own regular expressions and a fresh count for each window."""
    text = text or ""
    base = brute_base(text)
    out = set()
    for k in secrets.CLASSES:
        for m in re.finditer(k.candidate, text):
            s, at, end = m[0], m.start(), m.end()
            windows = [s[i : i + k.window] for i in range(max(1, len(s) - k.window + 1))]
            if not re.search(k.needs, s) or any(re.search(a, s) for a in secrets.ALLOWED):
                continue
            if any(a <= at and end <= e or kind == 0 and at < a < end < e for a, kind, e in base):
                continue
            if max(-sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values()) for w in windows) >= k.bits:
                out.add((at, 3, end))
    return sorted(base + sorted(out))


def test_secret_spans_and_masks(spark, docs, odd):
    rng = np.random.default_rng(11)
    bits = ["token = abcdef123 ", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "Zk93Lx72QmPa81TvYw0dRsBn45", " ", "é", "=", "api_key:", "/", "hello world ", "9F8E7D6C5B4A39281F0E", "password='", "\n"]
    made = ["".join(rng.choice(bits, int(rng.integers(0, 40)))) for _ in range(400)] + ["".join(rng.choice(list("aB3/+=f"), 300)) for _ in range(20)]
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(made)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)

    def masked(t):
        out, at = "", 0
        for a, _, e in brute_spans(t):
            out += t[at:a] + secrets.MARK if a >= at else ""
            at = max(at, e)
        return t if t is None else out + t[at:]

    rows = texts(every)
    assert Counter((r["doc_id"], r["spans"]) for r in secrets.secret_report(every).collect()) == Counter((i, said(brute_spans(t))) for i, t in rows)
    assert Counter(texts(secrets.redact(every))) == Counter((i, masked(t)) for i, t in rows)
    assert secrets.redact(empty(docs)).count() == 0 and secrets.redact(odd).columns == odd.columns


def test_running_totals_and_searches(spark):
    from footage_lake.llm.common import found_before, running

    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 2000)], "v array<int>")
    for r in rows.select("v", running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), running(F.col("v"), F.lit(-1), F.greatest).alias("m")).collect():
        assert r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))] and r["m"] == [max([-1, *r["v"][:k]]) for k in range(len(r["v"]))]
    for r in rows.select("v", *[found_before(F.size("v"), lambda k, b=b: F.get(F.col("v"), k) < b).alias(f"f{b}") for b in (0, 1, 256, 5000)]).collect():
        assert [r[f"f{b}"] for b in (0, 1, 256, 5000)] == [sum(x < b for x in r["v"]) for b in (0, 1, 256, 5000)]


def test_very_long_texts(spark, docs, labels):
    long = {1: "token = abcdef123 " * 30_000, 2: "a" * 300_000, 3: "one word after another, all in a row. " * 20_000, 4: "x\n" * 100_000}
    frame = spark.createDataFrame(list(long.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in secrets.secret_report(frame).collect()}
    assert found[1]["n_assign"] == 30_000 and found[2]["spans"] == "hex:0:300000" and found[3]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in secrets.redact(frame).collect()} == {**long, 1: "[SECRET] " * 30_000, 2: "[SECRET]"}
    words = {i: len(t.split()) for i, t in long.items()}
    rules, machine = quality_rules.learn_rules(docs, labels), toxicity.learn(docs, labels)
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.quality_report(frame, rules).collect()} == words
    assert {r["doc_id"]: r["n_words"] for r in token_counts.token_counts(frame).collect()} == words
    assert {r["doc_id"]: r["n_tokens"] for r in hmm.scored(frame).collect()} == {i: n + 1 for i, n in words.items()}
    assert {r["doc_id"]: r["n_chars"] for r in fingerprint.fingerprint_report(frame).collect()} == {i: len(t) for i, t in long.items()}
    pieces = packing.packed(frame).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert len(pieces) == 4 and all(r["n"] == r["of"] for r in pieces)
    assert len({r["fingerprint"] for r in simhash.near_duplicates(frame).collect()}) == 4
    assert simhash.keep_first(frame).count() == 4 and toxicity.toxicity_report(frame, machine).count() == 4


def test_entropy_of_values_behind_an_equals_sign(spark):
    key, few = "kJ8sQz4LmX0vTn2RbYc7WdPe", "wJalrXUtnFEMIxKbMDENGzbPxRfiCYzKq"
    cases = [
        (f"AWS_SECRET_ACCESS_KEY={few}", few),
        (f"export PRIVATE_KEY={key};", key),
        (f"https://x.org/a?sig={key}&b=1", key),
        ("sig=9F8E7D6C5B4A39281F0E", "9F8E7D6C5B4A39281F0E"),
        (f"key {few} end", few),
        (f"key {key}== end", f"{key}=="),
        (f"{'0123456789abcdef' * 2}Zk93Lx72QmPa81TvYw0d", f"{'0123456789abcdef' * 2}Zk93Lx72QmPa81TvYw0d"[:32]),
        ("Zk93Lx72QmPa81TvYw0d" + "fedcba98" * 3, "Zk93Lx72QmPa81TvYw0d" + "fedcba98" * 3),
        ("MY_LONG_SERVICE42_NAME7_api_key=hunter2222", None),
        ("utm_source=CamelCaseWordsWithoutDigitsInside&p=/wiki/About_us/page-2/The_Name", None),
    ]
    rows = secrets.secret_report(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id int, text string")).collect()
    for r in rows:
        text, want = cases[r["doc_id"]]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        found = [text[int(a) : int(b)] for kind, a, b in spans if kind == "entropy"]
        if r["doc_id"] == 6:  # the allow-list knows the alphabet in the whole; its base span stays
            assert [text[int(a) : int(b)] for _, a, b in spans] == [want]
        else:
            assert found == ([want] if want else []), text


# ---- fingerprints


@pytest.mark.parametrize("ranges", [None, 1, 29, 500])
def test_fingerprint_meets_next_document(docs, ranges):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_report(docs, ranges).collect()}
    every = sorted(texts(docs))
    for k, (i, t) in enumerate(every):
        after = every[(k + 1) % len(every)][1]
        new = fingerprint.edited(t, after)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == fingerprint.digest(t) and got[i]["near_edited"] == fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(new))
        assert got[i]["near_next"] == fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(after))
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.97 * len(got)


def plain_digest(text):
    """The digest by loops: triplets of each window of five bytes in a dict, quartiles of the sorted counts."""
    data, count = (text or "").encode(), Counter()
    data = data.ljust(5, b"\0") if data else data
    word = lambda x: x % 2**32
    for at in range(len(data) - 4):
        w = data[at : at + 5]
        for (i, j, k), salt in zip(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)), (2, 3, 5, 7, 11, 13), strict=True):
            h = word(w[i] * 0x9E3779B1)
            h = word(word((h ^ w[j]) + salt) * 0x85EBCA77)
            count[word((h ^ w[k]) * 0xC2B2AE3D) >> 24] += 1
    ordered = sorted(count.get(b, 0) for b in range(256))
    q1, q2, q3 = ordered[63], ordered[127], ordered[191]
    levels = [sum(count.get(b, 0) > q for q in (q1, q2, q3)) for b in range(256)]
    body = "".join(f"{sum(v << s for v, s in zip(levels[b : b + 4], (6, 4, 2, 0), strict=True)):02x}" for b in range(0, 256, 4))
    return min(255, round(12 * math.log2(len((text or "").encode()) + 1))), (16 * q1 // max(q3, 1)) % 16, (16 * q2 // max(q3, 1)) % 16, levels, body


def test_digests_and_likeness_by_plain_loops(docs):
    some = [t for _, t in texts(docs) if len(t) < 3000][:60] + ["", "a", "abcd", "é" * 70, "漢字" * 50]
    plain = [plain_digest(t) for t in some]
    for t, (length, r1, r2, _, body) in zip(some, plain, strict=True):
        assert fingerprint.digest(t) == f"{length:02x}{r1:x}{r2:x}{body}"
    for a, b in zip(range(len(some)), range(1, len(some)), strict=False):
        cost = abs(plain[a][0] - plain[b][0]) / 4
        for x, y in zip(plain[a][3], plain[b][3], strict=True):
            cost += {0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)]
        for k in (1, 2):
            step = abs(plain[a][k] - plain[b][k])
            cost += min(step, 16 - step) / 2
        want = 1.0 if plain[a] == plain[b] else max(0.0, 1 - cost / (1.4 * 256))
        assert fingerprint.likeness(fingerprint.digest(some[a]), fingerprint.digest(some[b])) == pytest.approx(want)


def test_fingerprint_of_text_ids_and_one_id(spark, docs):
    named = docs.select(F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("doc_id"), "text")
    plain = {f"n{r['doc_id']:05d}": tuple(r)[1:] for r in fingerprint.fingerprint_report(docs).collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in fingerprint.fingerprint_report(named, 13).collect()} == plain
    one = docs.select(F.lit(1).alias("doc_id"), "text")
    rows = fingerprint.fingerprint_report(one, 13).collect()
    assert Counter(r["n_chars"] for r in rows) == Counter(len(t) for _, t in texts(docs))


def test_fingerprint_edge_cases(docs, odd):
    rows = fingerprint.fingerprint_report(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert fingerprint.fingerprint_report(empty(docs)).count() == 0
    alone = fingerprint.fingerprint_report(docs.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    assert fingerprint.likeness(fingerprint.digest("abc" * 99), fingerprint.digest("abc" * 99)) == 1


# ---- tokens and packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(docs, odd, library):
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for i, t in texts(every):
        ids = library.encode(t or "", add_special_tokens=False).ids
        dec = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(every).collect()) == want
    assert bpe.round_trip(empty(docs)).count() == 0


def test_bpe_of_special_tokens_alone(spark, library):
    end, start = "<|endoftext|>", "<|startoftext|>"
    encoder = bpe.WordBpe()
    assert encoder.encode_words([]) == []
    for batch in ([end], ["hello world"], [f"hello {end} world"], [end + start, "", start * 3], [f"{end}hello"]):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids_of(batch)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in batch]
    frame = spark.createDataFrame([(1, end)], "doc_id bigint, text string")
    ids = np.array(library.encode(end, add_special_tokens=False).ids, "<u4").tobytes()
    row = bpe.round_trip(frame).first()
    assert (row["n_tokens"], row["ids_sha256"]) == (1, hashlib.sha256(ids).hexdigest())
    assert sum(r["length"] for r in packing.packed(frame).collect()) == 2


def test_bpe_on_random_strings(library):
    rng = np.random.default_rng(5)
    letters = list("abcdefghij'ABC .,!?%\t\n\x0b\x0c\x1c\x85 éÉßΑΣς12三́​İ😀ñ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    made = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(1500)] + ["".join(rng.choice(list("thinesro"), rng.integers(1, 30))) for _ in range(1500)]
    for t, (ids, dec) in zip(made, bpe.encoder().both_ways(made), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes() and dec == library.decode(want, skip_special_tokens=False)


def test_bpe_of_very_long_words(library):
    rng = np.random.default_rng(6)
    for word in ("".join(rng.choice(list("thinesroa"), 200_000)), "ab" * 100_000, "é" * 50_000 + "<|endoftext|>" + "x" * 50_000):
        (ids, _), want = next(bpe.encoder().both_ways([word])), library.encode(word, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes()


def test_both_ways_of_merging_agree():
    w, rng = bpe.encoder(), np.random.default_rng(12)
    for _ in range(500):
        symbols = w._symbols("".join(rng.choice(list("thinesroab"), int(rng.integers(1, 90)))).encode())
        assert w._merged_list(symbols) == w._merged_heap(symbols)


def test_bpe_forgets_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHARS", 50)
    monkeypatch.setattr(bpe, "_GROUP", 30)
    made = [f"word{k} other{k % 7} w{'x' * (k % 50)}" for k in range(300)]
    for t, ids in zip(made, bpe.encoder().ids_of(made), strict=True):
        assert ids == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert bpe.encoder().known_chars < 500


def test_compatible_pairs_are_their_own_encoding():
    w = bpe.encoder()
    rng = np.random.default_rng(2)
    words = [i for t, i in w.ids.items() if w.rank[i] >= 0 and not t.endswith(w.suffix)]
    ends = [i for t, i in w.ids.items() if t.endswith(w.suffix)]
    a, b = rng.choice(words, 800), rng.choice(ends, 800)

    def symbols(i):
        return [i] if w.rank[i] < 0 else symbols(w.left[i]) + symbols(w.right[i])

    for x, y, ok in zip(a, b, w.compatible(a, b), strict=True):
        assert ok == (w.merged(symbols(x) + symbols(y)) == [x, y])


def test_packing_is_gapless_and_whole(docs, odd, library):
    every = docs.select("doc_id", "text").where("doc_id > 20").unionByName(odd.select("doc_id", "text").where("doc_id <> 3"))
    rows = packing.packed(every).toPandas()
    for i, t in texts(every):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id.isna() if i is None else rows.doc_id == i].sort_values("start")
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()])[:-1]).all() and g.length.sum() <= 2048
        n = int(g.length.sum())
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0
    assert packing.packed(empty(docs)).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    for _ in range(100):
        length = int(rng.choice([8, 16, 64, 2048]))
        pieces = [(k, 0, int(n)) for k, n in enumerate(rng.integers(1, length + 1, rng.integers(0, 60)))]
        rooms: list[int] = []
        for p in sorted(pieces, key=lambda p: (-p[2], p[0])):
            fits = [k for k, r in enumerate(rooms) if r >= p[2]]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= p[2]
            else:
                rooms.append(length - p[2])
        got = packing.best_fit(pieces, length)
        assert sorted(length - sum(p[2] for p in w) for w in got) == sorted(rooms)


def test_token_counts_equal_wordpiece(docs, odd):
    from tokenizers import Tokenizer, models

    starts, rest = token_counts.vocabulary()
    vocab = {"[UNK]": 0}
    for p in starts + ["##" + p for p in rest]:
        vocab.setdefault(p, len(vocab))
    tk = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for i, t in texts(every):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        enc = [tk.encode(w).ids for w in words]
        want[i, len(words), sum(map(len, enc)), sum(0 in e for e in enc)] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(every).collect()) == want
    assert token_counts.token_counts(empty(docs)).count() == 0


# ---- near duplicates


def test_simhash_components(spark, docs, odd):
    base = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    near = [(20_000 + k, (t or "") + (" extra" if k % 2 else " Extra more")) for k, (_, t) in enumerate(texts(docs)[:60])]
    every = base.unionByName(spark.createDataFrame(near, "doc_id bigint, text string"))

    def brute(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, brute(t)) for i, t in texts(every)]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                up[root(a)] = root(b)
    lowest: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(k)] = min(i, lowest.get(root(k), i))
    want = Counter((i, f"{f:016x}", lowest.get(root(k))) for k, (i, f) in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(every).collect()) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_links_in_dense_and_hot_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    prints = {centre}
    while len(prints) < 400:
        x = centre
        for b in rng.choice(12, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b * 5)
        prints.add(x)
    prints = sorted(prints) + [int(x) for x in rng.integers(0, 2**62, 50)]
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    want = {frozenset(p for p in prints if root(p) == r) for r in {root(p) for p in prints}}
    for hot in (65_536, 20):
        monkeypatch.setattr(simhash, "HOT", hot)
        comps: dict = {}
        links = simhash.linked(frame)
        assert links.count() < 20 * len(prints)
        for n, r in simhash.components(links).collect():
            comps.setdefault(r, set()).add(n)
        lone = {frozenset([p]) for p in prints} - {frozenset([n]) for c in comps.values() for n in c}
        assert {frozenset(c) for c in comps.values()} | lone == want
        assert all(r == min(c) for r, c in comps.items())


def test_near_copies_and_keep_first(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for g in range(12):
        base = [word() for _ in range(300)]
        rows.append((g * 100, " ".join(base)))
        for c in range(1, 4):
            new = list(base)
            for at in rng.choice(300, c, replace=False):
                new[at] = word()
            rows.append((g * 100 + c, " ".join(new)))
        rows.append((g * 100 + 50, " ".join(base[:60] + [word() for _ in range(240)])))
    rows += [(5000, None), (5001, ""), (5002, "x y"), (5002, "x y"), (None, "x y"), (None, "only here"), (None, "only here")]
    rows += [(7, "one text of this id"), (7, "and wholly another one"), (7, "and wholly another one")]
    names = ["sig", "kept_id", "place", "near_id", "near_place", "n", "kept", "root", "first"]
    frame = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = Counter((i, t) for i, t in rows if i is not None and i < 5000 and i % 100 in (0, 50))
    want.update([(5000, None), (5002, "x y"), (None, "only here"), (7, "one text of this id"), (7, "and wholly another one")])
    assert got == want
    assert simhash.keep_first(empty(frame)).count() == 0


@pytest.mark.parametrize("block, band", [(1024, 4096), (8, 4096), (8, 5)])
def test_near_copies_are_decided_by_the_shingle_sets(spark, monkeypatch, block, band):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BAND", band)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 8))
    rows, shingles = [], lambda t: {tuple(w) for w in zip(*(t.split()[k:] for k in range(5)), strict=False)}
    for g in range(60):
        n = int(rng.integers(60, 400))
        base = [word() for _ in range(n)]
        rows.append((g * 100, " ".join(base)))
        for c in range(1, 6):
            # a tail of other words: similarity 0.7 to 0.9
            kept = round((n - 4) * 2 * (s := rng.uniform(0.7, 0.9)) / (1 + s)) + 4
            rows.append((g * 100 + c, " ".join(base[:kept] + [word() for _ in range(n - kept)])))
    # a chain of a template: each close to the next only
    base = [word() for _ in range(300)]
    for k in range(20):
        rows.append((9000 + k, " ".join(base[: 300 - 24 * (k % 2)] + [word() for _ in range(24 * (k % 2) + 18)])))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {rows[k][0]: rows[root(k)][0] for k in range(len(rows))}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()} == want
    assert {r["doc_id"] for r in simhash.keep_first(frame).collect()} == set(want.values())


def test_chains_keep_every_pair_within_the_distance():
    rng = np.random.default_rng(9)
    wide = rng.integers(0, 2**63, (400, 8)).astype(np.uint64)
    near = wide[0] ^ np.packbits((rng.random((300, 512)) < rng.uniform(0.1, 0.35, (300, 1))).astype(np.uint8), axis=1).view(np.uint64)
    every = np.concatenate([wide, near])
    for distance in (0, 60, 128):
        assert simhash._near(every, wide[0], distance).tolist() == np.flatnonzero(np.bitwise_count(every ^ wide[0]).sum(axis=1) <= distance).tolist()
    counts = rng.integers(0, 3, (3000, 4))
    for distance in (1, 2, 3):
        some = np.any([simhash._chain(counts, np.full(3000, s), distance) for s in range(4)], axis=0)
        assert (some == (counts.sum(axis=1) <= distance)).all()


# ---- learned filters


def test_quality_counts(spark, docs, odd, labels):
    loop = "a b c d e f g h i j " * 3 + "\nx\nx\n \n#* $%"
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(9999, loop)], "doc_id bigint, text string"))
    rules = quality_rules.learn_rules(docs, labels)
    want = Counter()
    for i, t in texts(every):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed] += 1
    rows = quality_rules.quality_report(every, rules).collect()
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.quality_report(empty(docs), rules).count() == 0
    assert quality_rules.keep_good(odd, rules).columns == odd.columns


def test_quality_verdicts_by_the_list(docs, labels):
    rules = quality_rules.learn_rules(docs, labels)
    assert rules.rules
    want = {}
    for i, t in texts(docs):
        n = lambda p, t=t: len(re.findall(p, t))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = len({k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars = max(1, sum(map(len, w)))
        f = {
            "words": len(w), "word_length": sum(map(len, w)) / max(1, len(w)), "symbols": n(r"[#*$%&|<>]") / chars, "upper": n("[A-Z]") / chars, "digits": n("[0-9]") / chars,
            "marks": n("[!?]") / chars, "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeated": repeated / max(1, len(w)),
        }
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        rejected = any(all((f[x.feature] > x.bound) == x.above for x in rule) for rule in rules.rules)
        want[i] = not failed and not rejected
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(docs, rules).collect()} == want
    assert {r["doc_id"] for r in quality_rules.keep_good(docs, rules).collect()} == {i for i, k in want.items() if k}
    assert quality_rules.keep_good(empty(docs), rules).count() == 0


def test_learners_take_a_repeated_id_once(spark, docs, labels, monkeypatch):
    """Copies of documents and labels change neither the rules nor the machine, and conflicting labels count as the least."""
    many, twice = docs.unionByName(docs).unionByName(docs), labels.unionByName(labels.withColumn("quality", F.lit(2)).withColumn("toxic", F.lit(2)))
    assert quality_rules.learn_rules(many, twice).rules == quality_rules.learn_rules(docs, labels).rules
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: fitted.append([(bytes(t), y) for t, y in rows]))
    toxicity.learn(docs, labels)
    toxicity.learn(many, twice)
    assert fitted[0] == fitted[1] and len(fitted[0]) > 20


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(0)
    rows = [({"x": float(a), "y": float(b)}, 0 if a > 0.7 and b < 0.4 else 1) for a, b in rng.random((1500, 2))]
    found = quality_rules.learn(rows)
    hit = lambda r: any(all((r[t.feature] > t.bound) == t.above for t in rule) for rule in found.rules)
    assert sum(hit(r) == (y == 0) for r, y in rows) > 0.97 * len(rows)
    assert quality_rules.learn([]).rules == [] and quality_rules.learn([({"x": 1.0}, 1)] * 5).rules == []


def test_machine_learns_a_pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append((np.array(sorted({10 * a, 20 * b, 30 + int(rng.integers(5))} - {0}), np.int32), int(a and b)))
    m = toxicity.fit(rows, n_terms=20, steps=600)
    score = lambda t: m.score(np.array([m.place[x] for x in t if x in m.place], int))
    assert score([10, 20, 31]) > 0.7 > score([10, 31]) and score([20, 31]) < 0.7 and score([31]) < 0.3
    assert 0 <= toxicity.fit([]).score(np.array([], int)) <= 1


def test_toxicity_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity_report(d, toxicity.learn(d, lab)).toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    test = rows[rows.held_out].merge(lab.toPandas(), on="doc_id")
    order = test.score.rank()
    pos = test.toxic == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97


def test_toxicity_scores_by_all_pairs(docs, labels):
    m = toxicity.learn(docs, labels)
    assert len(m.place) > 20
    want = {}
    for i, t in texts(docs):
        rows = [m.place[b] for b in toxicity.terms(t) if b in m.place]
        pairs = sum(float(m.factors[a] @ m.factors[b]) for k, a in enumerate(rows) for b in rows[:k])
        want[i] = round(1 / (1 + math.exp(-max(-30.0, min(30.0, m.bias + float(m.weight[rows].sum()) + pairs)))), 8)
    assert {r["doc_id"]: round(r["score"], 8) for r in toxicity.toxicity_report(docs, m).collect()} == want
    assert {r["doc_id"] for r in toxicity.keep_civil(docs, m).collect()} == {i for i, s in want.items() if s < toxicity.THRESHOLD}
    assert toxicity.keep_civil(empty(docs), m).count() == 0


def test_toxicity_edge_cases(odd, docs, labels):
    machine = toxicity.learn(docs, labels)
    rows = toxicity.toxicity_report(odd, machine).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.toxicity_report(empty(docs), toxicity.learn(empty(docs), labels)).count() == 0
    assert toxicity.keep_civil(odd, machine).columns == odd.columns


# ---- language model


def test_forward_and_expected_counts_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    k, m = 3, 5
    model = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k).T)
    seqs = [rng.integers(0, m, n) for n in (4, 1, 3, 5)]
    path = lambda s, p: model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(model.move[p[i - 1], p[i]] * model.emit[s[i], p[i]] for i in range(1, len(s)))
    total = [sum(path(s, p) for p in product(range(k), repeat=len(s))) for s in seqs]
    assert np.allclose(hmm.forward(model, seqs), np.log10(total))
    sums = hmm._zeros(model)
    hmm.expected(model, seqs, sums)
    want = np.zeros((k, k))
    for s, z in zip(seqs, total, strict=True):
        for p in product(range(k), repeat=len(s)):
            for i in range(1, len(s)):
                want[p[i - 1], p[i]] += path(s, p) / z
    assert np.allclose(sums[1], want) and np.isclose(sums[2].sum(), sum(map(len, seqs)))


def test_language_model_scores(docs, odd):
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = hmm.scored(every).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    c = Counter(w for i, t in texts(every) if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in texts(every))
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in rows) == want
    test = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert all(r["score"] <= 1e-9 for r in rows)
    assert hmm.scored(empty(docs)).count() == 0


def test_language_model_scores_by_a_plain_forward_pass(spark, docs, odd):
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    fit = hmm.fitted(every)
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    c = Counter(w for i, t in texts(every) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    ranked = sorted((w for w in c if w != b" "), key=lambda w: (-c[w], w))
    assert fit.own == [w.decode() for w in ranked[: hmm.OWN]] and len(ranked) > 2 * hmm.OWN
    words = sorted({w.decode() for _, t in texts(every) for w in tokens(t)})
    tail = dict(map(tuple, spark.createDataFrame([(w,) for w in words], "w string").select("w", hmm._tail_class(F.col("w"))).collect()))
    classes = tail | {w: k for k, w in enumerate(fit.own)}
    once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    discount = (once + 0.5) / (once + 2 * twice + 1)
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[classes[w.decode()]] += k
        v[classes[w.decode()]] += 1
    m = fit.model

    def plain(t):
        log, alpha = 0.0, None
        for w in tokens(t):
            k = classes[w.decode()]
            alpha = (m.start if alpha is None else [sum(alpha[a] * m.move[a, b] for a in range(len(alpha))) for b in range(len(alpha))]) * m.emit[k]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            own = k < hmm.OWN
            log += math.log10((1.0 if own else (c[w] - discount) / n[k]) if c[w] else (discount * v[k] / n[k] if n[k] else 1.0))
        return log

    some = [(i, t) for i, t in texts(every) if len(t or "") < 1500]
    want = Counter((i, round(plain(t), 5)) for i, t in some)
    got = Counter((r["doc_id"], round(r["score"], 5)) for r in hmm.scores(fit).collect())
    assert len(some) > 50 and not want - got


# ---- pages


def test_main_text_of_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")

    def brute(h):
        a = h[h.index("<article>") + 9 :]
        a = a[: a.index("</article>")] if "</article>" in a else a[: a.index("<footer>")]
        parts = re.split(r"<[^>]+>", re.sub(r"</?b>", "", a))
        return " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())

    rows = main_text.main_text(pages).toPandas().merge(pages.toPandas(), on="page_id")
    assert all(r.text == brute(r.html) and r.n_chars == len(r.text) for r in rows.itertuples())
    trees = main_text.learn(pages)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "just text & <b>more", "x"), (4, "u", "<p><<<a href='", "x")], "page_id bigint, url string, html string, text string")
    out = main_text.extracted(odd, trees).collect()
    assert len(out) == 5 and all(r["text"] == "" for r in out if r["page_id"] in (1, 2))
    assert main_text.main_text(empty(pages)).count() == 0


def test_foreign_truth_marks_are_not_read(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    marked = pages.withColumn("html", F.regexp_replace("html", "<(article|div|p)\\b", "<$1 data-truth='yes'"))
    nodes = [main_text.parse(r["html"]) for r in marked.limit(5).collect()]
    assert all(x.truth is None for p in nodes for x in p) and all(set(main_text.truths(p)) <= {0.0, 1.0} for p in nodes)
    want = {r["page_id"]: r["text"] for r in main_text.main_text(pages).collect()}
    assert {r["page_id"]: r["text"] for r in main_text.main_text(marked).collect()} == want


def test_long_pages_are_trained_on(spark):
    page = "<html><body><nav><a href=#>menu</a></nav><article>" + "<p>Some words of a long page, again and again.</p>" * 3000 + "</article><footer>end</footer></body></html>"
    frame = spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string")
    assert main_text._sampled(frame, 5) == [page]
    assert main_text.main_text(frame).first()["text"].startswith("Some words")


def test_main_text_without_marked_pages_and_with_copies(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()][:30]
    plain = [re.sub(r"(?i)(</?)(article|main)\b", r"\1div", p) for p in pages]
    frame = lambda rows: spark.createDataFrame([(k, "u", h) for k, h in enumerate(rows)], "page_id int, url string, html string")
    assert all(r["n_chars"] > 0 for r in main_text.main_text(frame(plain)).collect())
    copies = frame(pages[:4]).crossJoin(spark.range(100_000)).select("html")
    assert sorted(main_text._sampled(copies, 150)) == sorted(set(pages[:4]))


def test_main_text_of_plain_divisions_by_hand(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    prose = ["The harbour was quiet that morning, and only two boats had gone out before the fog came in.", "Nobody in the village could say when the old lamp had last been lit, but all of them knew who kept it.", "By noon the wind had turned; the nets were hung to dry along the wall, and the children came down to look."]
    said = "".join(f"<p>{p}</p>" for p in prose)
    menu = '<div class="nav"><ul><li><a href="#">Home</a></li><li><a href="#">News</a></li><li><a href="#">About us</a></li></ul></div>'
    cases = [
        f'<html><body>{menu}<div class="content">{said}</div><div class="footer">Copyright 2020</div></body></html>',
        f'<html><body>{menu}<div id="main"><h1>The lamp</h1>{said}</div><div class="comments"><div class="comment"><p>Nice story, thank you.</p></div></div></body></html>',
        f'<html><body>{menu}<article><p>{prose[0]}</p><div class="notice">We use cookies to improve this site.</div><p>{prose[1]}</p><p>{prose[2]}</p></article></body></html>',
    ]
    want = [" ".join(prose), "The lamp " + " ".join(prose), " ".join(prose)]
    frame = spark.createDataFrame([(k, "u", h) for k, h in enumerate(cases)], "page_id int, url string, html string")
    assert [r["text"] for r in main_text.extracted(frame, main_text.learn(pages)).orderBy("page_id").collect()] == want


def test_main_text_in_other_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    parsed = [main_text.parse(p) for p in pages[:30]] + [main_text.parse(p, True) for p in main_text.composed(pages[:30], 250)]
    trees = main_text.boost(np.concatenate([main_text.node_features(p) for p in parsed]), np.concatenate([main_text.truths(p) for p in parsed]), np.ones(sum(map(len, parsed))))
    exact = 0
    tests = main_text.composed(pages[30:], 100, seed=77)
    for h in tests:
        nodes = main_text.parse(h, True)
        want = " ".join(x.text for x, t in zip(nodes, main_text.truths(nodes), strict=True) if t and x.text)
        exact += main_text.decoded(nodes, trees.log_odds(main_text.node_features(nodes))) == want
    assert exact >= 85


@pytest.mark.parametrize(
    "inside, want",
    [
        ('<p>one</p><svg class="x"/><p>two</p>', "one two"),
        ("<p>one <math/> half</p><p>two</p>", "one half two"),
        ("<p>one <math><mi>x</mi><mo>=</mo><mn>2</mn></math> half</p>", "one x=2 half"),
        ("<p>one</p><video src=a><p>two</p>", "one two"),
        ("<button>go<p>one</p><select><option>a<p>two</p>", "go one a two"),
        ("<p>one <svg><svg><text>no</text></svg><text>no</text><path d='m'/></svg> half</p>", "one half"),
        ("<div><p>one</p><object>half</div><p>two</p><object></object>", "one half two"),
        ('<p data-truth="yes">one</p><p data-truth="0">two</p>', "one two"),
        ("<p>one <button><div>no</div><a href=x>no</a></button> half</p><script>if (a < b) no</script><p>two</p>", "one half two"),
    ],
)
def test_parser_drops_no_text_behind_a_rejected_element(inside, want):
    nodes = main_text.parse(f"<html><body><article>{inside}</article><p>after</p></body></html>")
    assert " ".join(x.text for x in nodes if x.text) == want + " after"


@pytest.mark.parametrize("page", ["<b>" * 170_000 + "</i>" * 130_000, "<b>" * 150_000 + "<p>" * 150_000, "<ul><foo>" * 60_000 + "</foo>" * 80_000, "<head>" * 170_000, "<title>" + "</title" * 150_000])
def test_parser_is_linear_in_open_and_unmatched_tags(page):
    start = time.process_time()
    main_text.parse(page + "<p>end</p>")
    assert time.process_time() - start < 10


def test_parts_of_an_article_that_are_none_of_its_text():
    apart = ['<div class="comments"><p>no</p><article>no</article></div>', "<form><p>no</p></form>", '<div class="advert">no</div>', "<aside>no</aside>", "<footer>no</footer>", '<ul class="share-bar social"><li>no</li></ul>']
    nodes = main_text.parse("<html><body><header>no</header><article class='post comment'><header><h1>yes</h1></header><p>yes</p>" + "<p>yes</p>".join(apart) + "</article><div>no</div></body></html>")
    assert {x.text for x, t in zip(nodes, main_text.truths(nodes), strict=True) if x.text and t} == {"yes"}
    assert {x.text for x, t in zip(nodes, main_text.truths(nodes), strict=True) if x.text and not t} == {"no"}


def test_decoding_never_keeps_below_a_rejected_node():
    nodes = main_text.parse("<div><p>a</p><div><p>b</p></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds = rng.normal(size=len(nodes))
        kept = main_text.decoded(nodes, odds)
        best = None
        for bits in range(2 ** (len(nodes) - 1)):
            on = [True] + [bool(bits >> k & 1) for k in range(len(nodes) - 1)]
            if all(on[x.up] or not on[k] for k, x in enumerate(nodes) if k):
                value = sum(o if f else -o for o, f in zip(odds, on, strict=True))
                best = max(best or (value, ""), (value, " ".join(x.text for x, f in zip(nodes, on, strict=True) if f and x.text)))
        assert kept == best[1]


def planted_near_copies(documents, seed=11):
    """(id, id of the edited copy, similarity) with the rows of both, for whole documents of 30 words on: words replaced until the shingle sets are 0.80 to 0.95 alike."""
    rng = np.random.default_rng(seed)
    rows, pairs = [], []
    for k, (i, text) in enumerate(documents):
        words = (text or "").split()
        if len(words) < 30:
            continue
        words = [f"{w}{i}" if j % 7 == 0 else w for j, w in enumerate(words)]  # so that no two documents are alike
        share = rng.uniform(0.80, 0.95)
        edits = max(1, int(len(words) * (1 - share) / (1 + share) / 5))
        other = list(words)
        for at in rng.choice(len(words), edits, replace=False):
            other[at] = f"edit{k}x{at}"
        a, b = (simhash.copy_shingles(" ".join(w)) for w in (words, other))
        shared = len(np.intersect1d(a, b))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs.append((2 * k, 2 * k + 1, shared / (len(a) + len(b) - shared)))
    return rows, pairs


def recall_of_near_copies(spark, documents):
    """Per similarity from 0.80 in steps of 0.05: planted pairs, and the share of them in one component; and pairs under 0.8 that are in one."""
    rows, pairs = planted_near_copies(documents)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    of = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    out = {}
    for low in (0.8, 0.85, 0.9, 0.95):
        own = [of[a] == of[b] for a, b, s in pairs if low <= s < low + 0.05]
        out[low] = (len(own), sum(own) / max(len(own), 1))
    return out, sum(of[a] == of[b] for a, b, s in pairs if s < 0.8)


def test_recall_of_planted_near_copies(spark):
    documents = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) < 8000").limit(400).collect()]
    found, wrong = recall_of_near_copies(spark, documents)
    assert sum(n for n, _ in found.values()) > 150 and wrong == 0
    assert all(share >= 0.99 for n, share in found.values() if n), found
