"""Interval joins in slots, state rules by joins, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from footage_lake.functions import spans
from footage_lake.sources import catalog


def made(seed, n, reach):
    rng = random.Random(seed)
    return [(rng.choice("ab"), k, *((s := rng.randint(0, reach)), s + rng.choice([0, 3, 40, reach // 2, -5]))) for k in range(n)]


@pytest.mark.parametrize("slot", [1, 7, 1000])
def test_meetings_by_brute_force(spark, slot):
    own, other = made(1, 60, 100), made(2, 50, 100) + [("a", 90, None, 3), ("b", 91, 4, None)]
    schema = "g string, k int, s bigint, e bigint"
    a, b = spark.createDataFrame(own, schema), spark.createDataFrame(other, schema.replace("k int", "n int")).withColumn("s", F.col("s"))
    got = sorted(tuple(r) for r in spans.overlapping(a, b, ["g"], "s", "e", "s", "e", ["n"], slot).select("k", "n").collect())
    whole = [o for o in other if None not in o]
    assert got == sorted((k, n) for g, k, s, e in own for h, n, x, y in whole if g == h and s <= e and x <= y and x <= e and y >= s)
    found = sorted(tuple(r) for r in spans.containing(a, b, ["g"], F.col("s") - 2, F.col("e") + 2, "s", "e", slot).select("k", "_start", "_end").collect())
    assert found == sorted((k, x, y) for g, k, s, e in own for h, n, x, y in whole if g == h and x <= y and x >= s - 2 and y <= e + 2)
    points = spark.createDataFrame([(g, t) for g in "abc" for t in [*range(-3, 160, 4), None]], "g string, t bigint")
    left = sorted((r["g"], -99 if r["t"] is None else r["t"]) for r in spans.outside(points, b, ["g"], "t", F.col("s") + 1, F.col("e") - 1, slot).collect())
    inside = lambda g, t: any(g == h and x + 1 <= t <= y - 1 for h, _, x, y in whole)
    assert left == sorted((g, -99 if t is None else t) for g in "abc" for t in [*range(-3, 160, 4), None] if t is None or not inside(g, t))


def test_a_million_pairs_do_not_meet(spark):
    """Points and regions of one long asset: slots keep the join near the sizes of its sides."""
    points = spark.range(100_000).select(F.lit("a").alias("g"), (F.col("id") * 100_000).alias("t"))
    regions = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") * 500_000).alias("s"), (F.col("id") * 500_000 + 150_000).alias("e"))
    assert spans.outside(points, regions, ["g"], "t", F.col("s"), F.col("e")).count() == 60_000


def test_long_spans_have_few_places(spark):
    """Each slot of a span is met in one of its places; a span of months has few of them."""
    rng = random.Random(5)
    own = [(k, (s := rng.randint(-300_000, 300_000)), s + rng.choice([0, 1, 2, 15, 16, 17, 255, 300, 5_000, 200_000])) for k in range(60)]
    frame = spark.createDataFrame([*own, (90, 5, 4), (91, None, 4)], "k int, s bigint, e bigint")
    found = {r["k"]: [(h["level"], h["node"]) for h in r["h"]] for r in frame.select("k", spans.homes_of(F.col("s"), F.col("e"), 1).alias("h")).collect()}
    assert found[90] == found[91] == []
    wide = lambda level: 16 ** max(level, 0)
    for k, s, e in own:
        assert sorted(t for level, n in found[k] for t in range(n * wide(level), (n + 1) * wide(level))) == list(range(s, e + 1))
        assert len(found[k]) <= 2 + 32 * spans.LEVELS
    asked = spark.range(-40, 40).select("id", spans.places_of(F.col("id")).alias("h")).collect()
    assert all([(h["level"], h["node"]) for h in r["h"]] == [(-1, r["id"]), *[(k, r["id"] // 16**k) for k in range(5)]] for r in asked)


def test_state_rules_by_joins_equal_the_array(spark):
    paths = ["/m/raw/a.mov", "/m/raw2/b.mov", "/m/raw/x/c_final.mov", "/n/d.mov", "e.mov", None, "/m/raw/a.mov", "/m/raw/x/sub/f.mov", "//g.mov"]
    rules = [(3, 1, "dir", "/m/raw", "RAW1"), (3, 2, "dir", "/m/raw/x/", "PROC"), (3, 3, "dir", "/", "TOP"), (1, 1, "regex", "final", "PROCESSED"), (2, 5, "regex", r"^d\\.", "ANALYZED"), (2, 4, "regex", r"^d", "FIRST")]
    media = spark.createDataFrame([(p, 1) for p in paths], "path string, n int")
    table = spark.createDataFrame(rules, "tier int, rule_seq int, kind string, pattern string, state string")
    rows = lambda frame: sorted((str(r["path"]), r["state"], r["n"]) for r in frame.collect())
    assert rows(catalog.resolve_state(media, table, most_rules=2)) == rows(catalog.resolve_state(media, table))
    many = spark.range(1_000_000).select(F.lit(3).alias("tier"), F.col("id").cast("int").alias("rule_seq"), F.lit("dir").alias("kind"), F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("pattern"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"))
    asked = spark.createDataFrame([("/d/123456/x/y.mov",), ("/d/99/z.mov",), ("/d/9999999/z.mov",)], "path string")
    assert sorted(r["state"] for r in catalog.resolve_state(asked, many).collect()) == ["RAW", "s123456", "s99"]


@pytest.mark.parametrize("slot", [7, 50, 10_000])
def test_points_within_spans(spark, slot):
    """Short, long, empty and backward spans, points on their ends and without a time, against all pairs."""
    rng = random.Random(slot)
    points = [(g, k, rng.choice([None, rng.randint(-500, 5000)])) for g in "ab" for k in range(200)]
    held = [(g, n, s, s + rng.choice([-3, 0, 1, 6, 7, 60, 900, 4000])) for g in "abc" for n, s in enumerate(rng.randint(-600, 5000) for _ in range(40))]
    held += [("a", 100 + n, t, t) for n, (g, _, t) in enumerate(points) if g == "a" and t is not None and n < 20]
    a = spark.createDataFrame(points, "g string, k int, t bigint")
    b = spark.createDataFrame(held, "g string, n int, s bigint, e bigint")
    got = sorted(tuple(r) for r in spans.within(a, b, ["g"], "t", "s", "e", ["n"], slot).collect())
    assert got == sorted((g, k, t, n) for g, k, t in points for h, n, s, e in held if g == h and t is not None and s <= t <= e)
