"""Close pairs, their greedy resolution, against all pairs and one plain walk."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from footage_lake.operators import close_pairs, dedup, people

LINK = "struct<shot_id:string,relationship_type:string,coherence_score:double>"


def takes(spark, rows, extra):
    """Shots (project_id, beat, idx, value) with the columns that a pair carries."""
    frame = spark.createDataFrame(rows, f"project_id string, beat string, idx bigint, {extra}")
    none = F.lit(None).cast(LINK)
    text = F.col("idx").cast("string")
    return frame.select("*", F.concat(F.lit("S"), text).alias("shot_id"), (F.col("idx") % 7).cast("double").alias("quality_score"), text.alias("source_file"), text.alias("source_path"), F.array().cast("array<string>").alias("characters"), F.lit("").alias("direction"), none.alias("prev"), none.alias("next"))


def clustered(n, dims, centres, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("least, cell, part", [(0.92, 10**6, 10**6), (0.92, 50, 40), (0.92, 20, 10**6), (0.5, 40, 33), (-0.2, 30, 17)])
def test_vector_pairs_equal_all_pairs(spark, least, cell, part):
    vectors = clustered(400, 8, 12, 5)
    vectors[7] = vectors[3]
    vectors[11] = 0
    rows = [("p" if k % 5 else "q", "b" if k % 3 else None if k == 0 else "c", k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [("p", "b", 1000, None), ("p", "b", 1001, [1.0, None] * 4), ("p", "b", 1002, [1.0] * 3), ("p", "b", 1003, [2.0] * 3), ("p", "b", 1004, [])]
    got = {(r["project_id"], r["beat"], r["i"], r["j"]): r["similarity"] for r in dedup.vector_pairs(takes(spark, rows, "vector array<double>"), least, related=False, cell=cell, part=part).collect()}
    want = {}
    for p, b, i, v in rows:
        for q, c, j, w in rows:
            if (p, b) == (q, c) and b is not None and i < j and v and w and len(v) == len(w) and None not in v + w:
                v_, w_ = (np.array(x) / (np.linalg.norm(x) or 1) for x in (v, w))
                if v_ @ w_ >= least:
                    want[p, b, i, j] = v_ @ w_
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_cells_meet_few_pairs_where_vectors_cluster():
    x = clustered(4000, 32, 40, 9)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    figures = close_pairs.cell_figures(x, x[:40], 0.98)
    print(figures)
    assert figures["replication"] < 8 and figures["met"] < 0.5


def close_hashes(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(0, 14)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("most, mode, few", [(10, "bits", 0), (10, "bits", 10**6), (11, "bits", 0), (3, "bits", 0), (2, "bits", 0), (0, "bits", 0), (20, "bits", 0), (10, "hex", 0), (2, "hex", 0)])
def test_hash_pairs_equal_all_pairs(spark, monkeypatch, most, mode, few):
    monkeypatch.setattr(dedup, "FEW_SHOTS", few)
    monkeypatch.setattr(close_pairs, "PART", 64)
    hashes = close_hashes(300, most)
    rows = [("p", "b" if k % 9 else "c", k, f"{h:016x}") for k, h in enumerate(hashes)] + [("p", "b", 900, None), ("p", "b", 901, "xyz"), (None, "b", 902, f"{hashes[1]:016x}")]
    got = {(r["i"], r["j"]): r["distance"] for r in dedup.hash_pairs(takes(spark, rows, "phash string"), most, mode, related=False).collect()}
    far = lambda a, b: (hashes[a] ^ hashes[b]).bit_count() if mode == "bits" else sum(x != y for x, y in zip(f"{hashes[a]:016x}", f"{hashes[b]:016x}", strict=True))
    want = {(a, b): far(a, b) for a in range(300) for b in range(a + 1, 300) if bool(a % 9) == bool(b % 9) and far(a, b) <= most}
    assert got == want and (want or most == 0)


def test_segments_meet_few_pairs(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("p", "b", k, rng.getrandbits(63)) for k in range(2000)], "project_id string, beat string, idx bigint, value bigint")
    assert dedup._budgets(10) == [2, 2, 2, 1] and dedup._budgets(3) == [0, 0, 0, 0] and dedup._budgets(1) == [0, 0, -1, -1]
    assert dedup._by_segments(rows, 10).count() == 0
    share = (3 * (1 + 16 + 120) + 17) / 2**16
    assert share < 0.2 / 10  # of the pairs that met by eleven runs of bits


def plain_walk(pairs):
    gone, lost = set(), {}
    for i, j, q_i, q_j in sorted(pairs):
        if i in gone or j in gone:
            continue
        loser, keeper = (j, i) if q_i >= q_j else (i, j)
        gone.add(loser)
        lost[loser] = keeper
    return lost


@pytest.mark.parametrize("n, edges, walk", [(60, 900, 40), (200, 600, 25), (40, 780, 100), (300, 299, 30), (30, 400, 10**6)])
def test_greedy_walk_in_blocks(spark, n, edges, walk):
    rng = random.Random(n)
    quality = [rng.randint(0, 5) for _ in range(n)]
    every = [(k, k + 1) for k in range(n - 1)] if edges == n - 1 else rng.sample([(a, b) for a in range(n) for b in range(a + 1, n)], edges)
    rows = [Row(project_id="p", beat=b, i=i, j=j, shot_a=str(i), shot_b=str(j), q_a=float(quality[i]), q_b=float(quality[j])) for b in ("x", "y") for i, j in every if b == "x" or i < 9]
    got = {(r["beat"], int(r["shot_id"])): int(r["kept_shot"]) for r in dedup.resolve_greedy(spark.createDataFrame(rows), walk).collect()}
    want = {}
    for b in ("x", "y"):
        own = [(r["i"], r["j"], r["q_a"], r["q_b"]) for r in rows if r["beat"] == b]
        want |= {(b, k): v for k, v in plain_walk(own).items()}
    assert got == want


def test_exact_copies_without_a_digest_stay(spark):
    frame = spark.createDataFrame([("p", f"S{k}", k, "RAW", 1.0, "候选", "", None if k < 3 else "x") for k in range(5)], "project_id string, shot_id string, idx bigint, state string, quality_score double, status string, dedup_reason string, md5 string")
    rows = {r["shot_id"]: r["status"] for r in dedup.dedup_exact(frame).collect()}
    assert [rows[f"S{k}"] for k in range(5)] == ["候选"] * 4 + [dedup.DISCARDED]


@pytest.mark.parametrize("part, n", [(10_000, 300), (20, 300), (5_000, 100_000)])
def test_nearest_person_equals_brute_force(spark, part, n):
    persons = clustered(n, 6, 30, 2)
    faces = np.concatenate([persons[:40] + 0.05, -persons[:5], clustered(60, 6, 30, 3)])
    gallery = spark.createDataFrame([(f"n{k}", v.tolist()) for k, v in enumerate(persons)], "person string, centroid array<double>")
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(faces)] + [(900, None), (901, [1.0])], "face_id int, embedding array<double>")
    got = {r["face_id"]: (r["person"], r["similarity"]) for r in people.nearest_person(asked, gallery, 0.9, part).collect()}
    near = (faces / np.linalg.norm(faces, axis=1, keepdims=True)) @ (persons / np.linalg.norm(persons, axis=1, keepdims=True)).T
    assert len(got) == len(faces) + 2 and got[900] == got[901] == ("unknown", None)
    for k in range(len(faces)):
        best = near[k].max()
        if best >= 0.9:
            assert got[k] == (f"n{near[k].argmax()}", pytest.approx(best))
        else:
            assert got[k][0] == "unknown"


def test_close_pairs_are_told_tile_by_tile(spark):
    """Of 1200 equal hashes all 719,400 pairs are close; a batch holds those of one tile at most."""
    import pyarrow as pa

    n, kinds = 1200, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    columns = [pa.array([7] * n, pa.int64()), pa.array([True] * n), pa.array(["p"] * n), pa.array(["b"] * n), pa.array(range(n), pa.int64()), pa.array([5] * n, pa.int64())]
    rows = pa.RecordBatch.from_arrays(columns, ["place", "own", "project_id", "beat", "idx", "value"])
    sizes = [b.num_rows for b in close_pairs._found(iter([rows]), close_pairs.Measure("bits", 3), kinds)]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= close_pairs._ROWS * close_pairs._COLUMNS and len(sizes) > 1
