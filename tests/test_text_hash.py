"""The similarity hash of whole texts, and the group pass that stands on it."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from footage_lake.functions import text_hash
from footage_lake.plans import edit_queries, registry  # noqa: F401 (it registers queries)

BASE = [f"w{k}" for k in range(400)]


def _plain(text: str) -> str:
    words = text.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ")
    digests = [hashlib.md5(w.encode()).digest() for w in words if w]
    shingles = [digests[k : k + 3] for k in range(max(len(digests) - 2, 1))] if digests else []
    hashes = [_mixed(s) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0:016x}"


def _mixed(row: list[bytes]) -> int:
    out = 0
    for k, d in enumerate(row):
        out ^= int.from_bytes(d[4 * k : 4 * k + 8], "big")
    return out


def test_hash_equals_a_plain_count(monkeypatch):
    texts = ["", " \n", "a", "a b", "a b c", "a  b\tc\x0bd", "é x y z", " ".join(BASE), "a " * 700]
    want = [_plain(t) for t in texts]
    known = text_hash._Words()
    assert [text_hash.similarity_hash(t, known) for t in texts] == want
    monkeypatch.setattr(text_hash, "_HELD", 64)
    monkeypatch.setattr(text_hash, "_KEPT", 50)
    assert [text_hash.similarity_hash(t, known) for t in texts * 2] == want * 2


@pytest.fixture
def group(spark, tmp_path):
    """Runs dedup_group and its SQL on documents; their rows must be equal."""

    def of(rows):
        spark.createDataFrame([("xx", "s", k, t) for k, t in rows], "lang string, source string, doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
        got = sorted(map(tuple, registry.QUERIES["dedup_group"](spark, str(tmp_path)).collect()))
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == sorted(c.execute(registry.ORACLE["dedup_group"]).fetchall())
        return {r[1]: r[2:] for r in got}

    return of


def test_group_reads_whole_texts(group):
    """Texts of one opening are no copies; a copy with another opening is one."""
    text = lambda words: " ".join(words)
    rows = [(2, text(BASE)), (5, text(["new", *BASE[1:]])), (8, text([BASE[0], *[f"x{k}" for k in range(400)]])), (11, text([*BASE[:200], "more", *BASE[200:]])), (14, None), (20, ""), (23, " \n")]
    told = group(rows)
    assert told["d5"] == ("废弃", "L2视觉重复: 与 d2") and told["d11"] == ("废弃", "L2视觉重复: 与 d2")
    assert told["d2"] == told["d8"] == told["d14"] == ("候选", "")
    assert told["d20"] == ("废弃", "L2视觉重复: 与 d23")


def test_short_texts_equal_the_sql(group):
    group([(3 * k + 2, " ".join(f"{'ab'[k * n % 7 % 2]}{n % 5}" for n in range(k % 9))) for k in range(300)])


def test_hash_is_taken_once(spark):
    rows = spark.createDataFrame([("a b c",)], "text string").select(text_hash.text_hash(F.col("text")).alias("h")).where("h <> ''")
    plan = rows.select("h", F.substring("h", 1, 8), F.substring("h", 9, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
