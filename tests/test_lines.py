"""Documents in lines, texts as lines and cut times as rows, against plain loops over whole arrays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from footage_lake.functions import ordered
from footage_lake.operators import cuts, scripts, timeline
from footage_lake.sources import tables

CUT = "project_id string, asset_id string, t_us bigint"
ASSET = "project_id string, asset_id string, duration_us bigint"


def stays(times, end, least, tail):
    kept = [0]
    for t in sorted({t for t in times if 0 < t < end}):
        if t - kept[-1] >= least:
            kept.append(t)
    if tail and len(kept) > 1 and end - kept[-1] < least:
        kept.pop()
    return [*kept, end]


@pytest.mark.parametrize("tail", [True, False])
def test_cut_times_equal_the_fold_in_blocks_of_any_size(spark, tail):
    rng = random.Random(3)
    ends = {"a": 20_000, "b": 30_000, "c": 5_000, "d": 1_000, "none": 9_000, "zero": 0}
    times = {k: [rng.randint(-500, e + 500) for _ in range(e // 150)] for k, e in ends.items()}
    times["c"] = [1_000, 1_000, 4_500, 4_100]
    # steady steps: walks from different cuts never meet
    times["d"], ends["d"] = list(range(0, 24_000, 700)), 24_000
    times["e"], ends["e"] = list(range(0, 90_000, 30)), 90_000
    made = spark.createDataFrame([("p", k, t) for k, ts in times.items() for t in ts], CUT)
    whole = spark.createDataFrame([("p", k, e) for k, e in ends.items()] + [("p", "null", None)], ASSET)
    want = {k: stays(times.get(k, []), e, 1000, tail) for k, e in ends.items() if e > 0}
    for span in (1, 3, 10_000):
        got = {}
        for r in cuts.kept_cuts(made, whole, 1000, tail, span).collect():
            got.setdefault(r["asset_id"], []).append(r["t_us"])
        assert {k: sorted(v) for k, v in got.items()} == want
    arrays = {r["asset_id"]: r["times"] for r in cuts.cut_times(made, whole, 1000, tail).collect()}
    assert arrays == want
    array = made.groupBy("asset_id").agg(F.collect_set("t_us").alias("t")).join(whole, "asset_id").where("duration_us > 0")
    every = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint"), "duration_us"), F.filter("t", lambda x: (x > 0) & (x < F.col("duration_us"))))))
    folded = {r["asset_id"]: r["k"] for r in array.select("asset_id", cuts.kept_times(every, 1000, tail).alias("k")).collect()}
    assert folded == {k: want[k] for k in folded}


@pytest.mark.parametrize("seed", range(40))
def test_walks_of_a_block_equal_a_walk_from_each_state(seed):
    """Every state before a block, by one table of the block; rows without a length and equal marks among them."""
    rng = random.Random(seed)
    least, rows, at = rng.choice([1, 5, 20]), [], rng.randint(0, 9)
    for _ in range(rng.randint(1, 60)):
        n = rng.choice([0, 0, 1, 2, 7, 30]) if seed % 2 else 0
        rows.append((at, at + n))
        at += n if seed % 2 else rng.choice([1, 2, 3, 9])
    walks = ordered._Walks(rows[0][0] + least)
    for m, r in rows:
        walks.add(m, r, least)
    table = list(walks.ends())
    assert all(a[1] != b[1] for a, b in zip(table, table[1:], strict=False))
    for last in [ordered.NEVER, *range(rows[0][0] - 2 * least, rows[0][0] + 1)]:
        want = last
        for m, r in rows:
            want = m if r - want >= least else want
        assert next((end for upto, end in table if upto - last >= least), last) == want


def test_cut_times_of_no_cuts(spark):
    got = cuts.kept_cuts(spark.createDataFrame([], CUT), spark.createDataFrame([("p", "a", 5)], ASSET)).collect()
    assert sorted(r["t_us"] for r in got) == [0, 5]


def chunked(lines, most):
    done, cur, n = [], None, 0
    for p in lines:
        if cur is not None and n + len(p) > most:
            done.append("\n".join(cur))
            cur, n = [p], len(p)
        else:
            cur, n = [*(cur or []), p], n + len(p)
    return [*done, "\n".join(cur)]


def test_chunks_of_lines_equal_the_fold(spark):
    rng = random.Random(5)
    texts = {k: ["é" * rng.choice([0, 0, 1, 3, 9, 12, 30]) for _ in range(n)] for k, n in {"a": 80, "b": 1, "c": 25}.items()}
    texts["same"], texts["empty"], texts["long"] = ["abcd"] * 60, [""], ["x" * 99, "", "y"]
    rows = [(k, 2 * n + 7, p) for k, ps in texts.items() for n, p in enumerate(ps)]
    lines = spark.createDataFrame(rows, "script_id string, line_no int, line string").withColumn("chunk", F.lit("clash"))
    want = {(k, n): c for k, ps in texts.items() for n, c in enumerate(chunked(ps, 20))}
    for span in (1, 4, 10_000):
        got = {(r["script_id"], r["chunk_no"]): r["chunk"] for r in scripts.chunked_lines(lines, 20, span).collect()}
        assert got == want
    whole = spark.createDataFrame([(k, "\n".join(ps)) for k, ps in texts.items()], "script_id string, text string")
    at_once = whole.select("script_id", F.posexplode(scripts.chunks(F.col("text"), 20)).alias("n", "c")).collect()
    assert {(r["script_id"], r["n"]): r["c"] for r in at_once} == want


def test_null_and_no_lines(spark):
    lines = spark.createDataFrame([("s", 0, None), ("s", 1, "a")], "script_id string, line_no int, line string")
    assert [r["chunk"] for r in scripts.chunked_lines(lines).collect()] == ["\na"]
    assert scripts.chunked_lines(lines.where("false")).isEmpty()


def read_parts(path):
    """Lines of each project's files in the order of the files' names, and how many files those are."""
    found = {}
    for folder in sorted(path.glob("project_id=*")):
        parts = sorted(folder.glob("part-*"))
        found[folder.name.split("=")[1]] = ("".join(p.read_text() for p in parts).splitlines(), len(parts))
    return found


def test_a_large_project_is_written_by_many_tasks_in_order(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, "q").otherwise("p").alias("project_id"), (F.col("id") * 7919 % 5000).alias("k"), F.concat(F.lit('"'), F.col("id").cast("string")).alias("v"))
    rows = rows.unionByName(rows.where("k < 3")).unionByName(spark.createDataFrame([("p", None, None)] * 2, "project_id string, k bigint, v string"))
    lines = tables.stage_lines(rows, "shots")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_lines(lines, str(tmp_path / "k1"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r["project_id"]: r["value"] for r in tables.stage_documents(rows, "shots").collect()}
    found = read_parts(tmp_path / "k1")
    assert found["p"][1] > 1 and found.keys() == want.keys()
    for project, (got, _) in found.items():
        assert "".join(got) == want[project]
        records = [(r.get("k", -1), r.get("v", "")) for r in json.loads("".join(got))["shots"]]
        assert records == sorted(records) and len(records) == rows.where(F.col("project_id") == project).count()


def test_exports_in_lines(spark, tmp_path):
    d = spark.range(1, 1501).select(
        F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("project_id"), F.col("id").cast("int").alias("sequence"), F.concat(F.lit("S"), "id").alias("shot_id"),
        F.concat(F.lit("f"), F.col("id") % 40).alias("source_file"), F.concat(F.lit("/m/a&b"), F.col("id") % 40).alias("source_path"), F.lit("00:00:01:00").alias("tc_in"), F.lit("00:00:03:00").alias("tc_out"), F.lit(24.0).alias("fps"),
        F.when(F.col("id") % 5 == 0, "2x").otherwise("1x").alias("speed"), F.lit("连续剪辑").alias("technique"), F.when(F.col("id") % 7 == 0, "叠化").otherwise("硬切").alias("transition"), F.lit("保留").alias("audio"), F.lit("").alias("notes"),
    )
    for name, lines, text, joint in (("edl", timeline.edl_document(d), timeline.edl_text(d), "\n"), ("xml", timeline.xml_document(d), timeline.xml_text(d), "")):
        tables.write_lines(lines, str(tmp_path / name))
        want = {r["project_id"]: r["value"] for r in text.collect()}
        assert {k: joint.join(got) for k, (got, _) in read_parts(tmp_path / name).items()} == want
    assert want["p0"].startswith('<?xml version="1.0"') and want["p0"].count("<asset-clip") == 750 and want["p0"].count("<asset id") == 20 and "a&amp;b" in want["p0"]
