"""Walks over whole projects in blocks, against one plain walk."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footage_lake.functions import ordered
from footage_lake.operators import edit

DECISION = "project_id string, seq bigint, shot_id string, source_file string, tc_in string, tc_out string, speed string, technique string, transition string, audio string, purpose string, notes string"
TAKE = "project_id string, shot_id string, source_file string, tc_in string, tc_out string, duration_sec double, fps double, state string, status string, quality_score double, tags array<string>, camera_movement string, act string, beat string"


def edits(spark, n, seed, projects=2):
    """(decisions, shots, rows): decisions with and without shots, of several speeds and caps."""
    rng = random.Random(seed)
    shots, decisions = [], []
    for p in range(projects):
        for k in range(n):
            tags = ["慢动作"] if rng.random() < 0.2 else []
            shots.append((f"p{p}", f"S{k:04d}", f"f{k}", "00:00:00:00", "00:00:05:00", rng.choice([5.0, 7.3, 2.04]), rng.choice([24.0, 60.0, 120.0]), rng.choice(["RAW", "PROCESSED", "ANALYZED"]), "核心", rng.randint(0, 3) / 4, tags, "", "第1幕", "b"))
            shot = f"S{k:04d}" if rng.random() < 0.9 else f"X{k}"
            decisions.append((f"p{p}", k + 1, shot, f"f{k}", "00:00:00:00", "00:00:05:00", rng.choice(["1x", "2x", "50%", "1.5x"]), "t", "硬切", "a", "", ""))
    return spark.createDataFrame(decisions, DECISION), spark.createDataFrame(shots, TAKE)


def caps(rows):
    """(row, cap) in order of one project's decisions with their shots."""
    special = [s is not None and (bool(s["tags"]) or s["fps"] >= 60) for _, s in rows]
    for k, (d, s) in enumerate(rows):
        near = sum(special[max(0, k - 2) : k + 3]) - special[k]
        if s is None or s["state"] == "PROCESSED":
            yield d, s, None
        else:
            yield d, s, 1.0 if s["fps"] < 60 else 1.5 if special[k] and near >= 2 else 4.0 if special[k] else 2.0


SPEED = {"1x": 1.0, "2x": 2.0, "50%": 0.5, "1.5x": 1.5}


def said(x):
    if abs(x - 1) < 0.01:
        return "1x", 1.0
    if x < 1:
        return f"{round(x * 100)}%", round(x * 100) / 100
    if abs(x - round(x)) < 0.01:
        return f"{round(x)}x", float(round(x))
    tenth = Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP)
    return f"{tenth}x", float(tenth)


def plain_slow(decisions, shots, least):
    out = {}
    take = {(s["project_id"], s["shot_id"]): s for s in shots}
    for p in {d["project_id"] for d in decisions}:
        rows = [(d, take.get((p, d["shot_id"]))) for d in sorted((d for d in decisions if d["project_id"] == p), key=lambda d: d["seq"])]
        length = lambda d, s: (s["duration_sec"] if s else 5.0) / SPEED[d["speed"]]
        total = round(round(sum(length(*r) for r in rows), 6) * 1e9)
        for d, s, cap in caps(rows):
            speed, deficit = d["speed"], (round(least * 1e9) - total) / 1e9
            if cap is not None and deficit > 0 and (room := s["duration_sec"] * cap - length(d, s)) > 0:
                speed, x = said(s["duration_sec"] / (length(d, s) + min(room, deficit)))
                total += round((s["duration_sec"] / x - length(d, s)) * 1e9)
            out[p, d["seq"]] = speed
    return out


@pytest.mark.parametrize("run, least", [(7, 700.0), (7, 1e6), (10, 430.0), (100_000, 700.0), (3, 0.0), (25, 900.25)])
def test_slowing_in_blocks(spark, run, least):
    decisions, shots = edits(spark, 90, run)
    target = spark.createDataFrame([("p0", least), ("p1", least)], "project_id string, target_min double")
    got = {(r["project_id"], r["seq"]): r["speed"] for r in edit.extend_slow(decisions, shots, target, run=run).collect()}
    assert got == plain_slow(decisions.collect(), shots.collect(), least)


@pytest.mark.parametrize("run, low, high", [(5, 180.0, 200.0), (5, 1e6, 1e7), (1000, 180.0, 185.0), (4, 100.0, 101.0)])
def test_supplements_in_blocks(spark, run, low, high):
    decisions, shots = edits(spark, 12, 3)
    _, spare = edits(spark, 60, 4)
    rng = random.Random(run)
    places = {f"S{k:04d}": rng.randint(1, 4) for k in range(60)}
    spare = spare.withColumn("act", F.concat(F.lit("第"), F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col("shot_id")].cast("string"), F.lit("幕")))
    band = spark.createDataFrame([("p0", low, high), ("p1", low, high)], "project_id string, target_min double, target_max double")
    rows = edit.extend_supplement(decisions, shots, spare, band, run=run).where("seq = 0").collect()
    took = {(d["project_id"], d["shot_id"]) for d in decisions.collect()}
    total = {r["project_id"]: r["total_sec"] for r in edit.projected_duration(decisions, shots).collect()}
    want = set()
    for s in sorted(spare.collect(), key=lambda s: (s["project_id"], places[s["shot_id"]], s["shot_id"])):
        p, n = s["project_id"], s["duration_sec"]
        if (p, s["shot_id"]) not in took and total[p] < low and total[p] + n <= high:
            total[p] += n
            want.add((p, s["shot_id"]))
    assert {(r["project_id"], r["shot_id"]) for r in rows} == want and len(rows) == len(want)


def test_order_past_a_million_places(spark):
    decisions, _ = edits(spark, 4, 1, 1)
    seqs = [1_000_005, 0, 3, 0]
    rows = decisions.withColumn("seq", F.array(*[F.lit(x).cast("bigint") for x in seqs])[(F.col("seq") - 1).cast("int")]).withColumn("shot_id", F.array(*[F.lit(x) for x in "bzay"])[(F.substring("source_file", 2, 1)).cast("int")])
    assert [r["shot_id"] for r in edit.final_order(rows).orderBy("sequence").collect()] == ["a", "b", "y", "z"]
    assert sorted(r["sequence"] for r in edit.final_order(rows).collect()) == [1, 2, 3, 4]


def test_drops_by_quality_over_many_buckets(spark):
    decisions, shots = edits(spark, 80, 9)
    take = {(s["project_id"], s["shot_id"]): s for s in shots.collect()}
    kept = {(r["project_id"], r["seq"]) for r in edit.compress_drop(decisions, shots, F.lit(120.0)).collect()}
    want = set()
    for p in ("p0", "p1"):
        rows = [(d, take.get((p, d["shot_id"]))) for d in decisions.collect() if d["project_id"] == p]
        length = lambda d, s: (s["duration_sec"] if s else 5.0) / SPEED[d["speed"]]
        total, gone = sum(length(*r) for r in rows), set()
        for d, s in sorted(rows, key=lambda r: (r[1]["quality_score"] if r[1] else 0.0, r[0]["seq"])):
            if round(total, 9) > 120.0:
                total -= length(d, s)
                gone.add(d["seq"])
        want |= {(p, d["seq"]) for d, _ in rows} - {(p, k) for k in gone}
    assert kept == want and 0 < len(kept) < 160


@pytest.mark.parametrize("block, reach", [(4, 2), (5, 3), (1000, 2), (7, 1)])
def test_sums_beside(spark, block, reach):
    rng = random.Random(block)
    n = {"a": 23, "b": 1, "c": 8}
    values = {(g, k): rng.randint(0, 9) for g, m in n.items() for k in range(1, m + 1)}
    frame = spark.createDataFrame([(g, k, v) for (g, k), v in values.items()], "g string, k int, v int")
    got = {(r["g"], r["k"]): r["near"] for r in ordered.beside(frame, ["g"], "k", {"near": F.col("v")}, reach, block).collect()}
    assert got == {(g, k): sum(values.get((g, k + d), 0) for d in range(-reach, reach + 1) if d) for g, k in values}


@pytest.mark.parametrize("run, wild", [(5, True), (6, False), (1000, True)])
def test_scanned_blocks_equal_one_walk(spark, run, wild):
    """A step that depends on all before it in a way that no guess foresees."""
    rng = random.Random(run)
    rows = [(g, k, rng.randint(1, 50)) for g in ("a", "b") for k in range(1, 41)]
    frame = spark.createDataFrame(rows, "g string, k int, v bigint")
    step = (lambda t, v: (t + (v if t % 3 else -v), (t,))) if wild else (lambda t, v: (t + v, (t,)))
    got = {(r["g"], r["k"]): r["was"] for r in ordered.scanned(frame, ["g"], "k", F.lit(7), F.col("v"), ["v"], step, {"was": pa.int64()}, run).collect()}
    want = {}
    for g in ("a", "b"):
        total = 7
        for _, k, v in sorted(r for r in rows if r[0] == g):
            want[g, k] = total
            total, _ = step(total, v)
    assert got == want


@pytest.mark.parametrize("low, high, few", [(400.0, 420.0, True), (400.0, 401.0, False), (20.0, 60.0, True), (1e6, 2e6, False), (400.0, 406.0, True)])
def test_supplements_out_of_reach_are_not_walked(spark, monkeypatch, low, high, few):
    """Shots of beats that the walk can't reach are left out before it; what is used is that of one plain walk over all."""
    rng = random.Random(int(high))
    lengths = [None, -3.0, 2.5, 4.25, 5.5, 30.0, 12.0]
    beat = lambda n: None if n == 39 else f"第{n}场" if n % 2 else f"b{n}"
    act = lambda n: ["第1幕", "第一幕", "第2幕"][n % 3]
    rows = [(p, f"S{k:04d}", f"f{k}", "00:00:00:00", "00:00:05:00", rng.choice(lengths), act(rng.randint(0, 2)), beat(rng.randint(0, 39))) for p in ("p0", "p1") for k in range(1000)]
    spare = spark.createDataFrame(rows, "project_id string, shot_id string, source_file string, tc_in string, tc_out string, duration_sec double, act string, beat string")
    totals = spark.createDataFrame([("p0", 7.5, low, high), ("p1", 60.0, low, high)], "project_id string, total_sec double, target_min double, target_max double")
    decisions = spark.createDataFrame([("p0", "S0003"), ("p1", "S0001")], "project_id string, shot_id string")
    walked = []
    monkeypatch.setattr(edit, "scanned", lambda rows, *more: walked.append(rows.count()) or ordered.scanned(rows, *more))
    got = {(r["project_id"], r["shot_id"]) for r in edit._supplements(decisions, totals, spare).collect()}
    want, total = set(), {"p0": 7.5, "p1": 60.0}
    in_order = edit.narrative_order(spare.join(decisions, ["project_id", "shot_id"], "left_anti")).orderBy("project_id", "narrative_no").collect()
    for r in in_order:
        p, n = r["project_id"], r["duration_sec"]
        if n is not None and total[p] < low and total[p] + n <= high:
            total[p] += n
            want.add((p, r["shot_id"]))
    assert got == want and (want or low < 60)
    assert (walked[0] < 1000) == few
