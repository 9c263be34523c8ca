"""Whitening against numpy on the whole table."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footage_lake.llm import whitening
from footage_lake.llm.common import tree_sum

SF = "/root/testdata/sf0.001"


def brute(rows, counts=False, most=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = {k: tuple(math.floor(256 * c) for c in v) + (0,) * (dims - len(v)) for k, (_, v) in enumerate(kept)}
    weight = Counter(x.values())
    distinct = sorted(weight)
    w = np.array([weight[d] if counts else 1 for d in distinct], float)
    matrix = np.array(distinct, float)
    n, sums = int(w.sum()), [sum(int(a) * int(d[j]) for a, d in zip(w, distinct, strict=True)) for j in range(dims)]
    centred = matrix - np.average(matrix, axis=0, weights=w)
    v = (centred * w[:, None]).T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    out = {}
    for k, (i, _) in enumerate(kept):
        gap = np.array(x[k], float) - np.array(sums) / n
        out.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))), []).append(np.abs(gap @ q / np.sqrt(e)))
    return n, e / np.trace(v), out


def check(spark, frame, rows, counts=False):
    n, explained, want = brute(rows, counts)
    found = whitening.whiten(frame, counts=counts).collect()
    assert len(found) == 4 * sum(map(len, want.values()))
    by_row = {}
    for r in found:
        assert r["n"] == n and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(abs(r["whitened"]))
    assert by_row.keys() == want.keys()
    for key, parts in by_row.items():
        assert all(len(parts[j]) == len(want[key]) for j in range(1, 5))
        np.testing.assert_allclose([sorted(parts[j])[0] for j in range(1, 5)], [sorted(x[j] for x in want[key])[0] for j in range(4)], atol=1e-8)
    return found


@pytest.mark.parametrize("counts", [False, True])
def test_whitening_of_the_table(spark, counts):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = [tuple(r) for r in frame.select("vec_id", "embedding").collect()]
    first = given[0][1]
    odd = [(-1, None), (-2, [1.0, None]), (-3, [math.nan] * 64), (-4, [math.inf] + [0.0] * 63), (-5, first), (-5, first), (None, first), (-6, [1.5, -0.25]), (-7, [1.5, -0.25] + [0.0] * 62), (-8, []), (-9, [-0.0] * 64)]
    odd += [(k, given[1][1]) for k in range(1000, 1300)]
    more = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>")
    every = frame.select("vec_id", "embedding").unionByName(more).withColumn("component", F.lit("x")).withColumn("rows", F.lit(1))
    found = check(spark, every, [tuple(r) for r in every.select("vec_id", "embedding").collect()], counts)
    sign = {}
    for r in found:
        if r["vec_id"] in (-5, 0, None):
            assert sign.setdefault(r["component"], r["whitened"]) == r["whitened"]


def test_whitening_of_few_vectors(spark):
    schema = "vec_id string, embedding array<double>"
    for rows in ([], [("a", [1.0, 2.0])] * 3, [("a", None)], [("a", []), (None, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = spark.createDataFrame([("a", [0.0, 1.0, 2.0]), ("b", [1.0, 1.0, 2.0]), ("b", [1.0, 1.0, 2.0])], schema)
    rows = sorted(tuple(r) for r in whitening.whiten(line).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("a", 1, 2, 256**2), ("b", 1, 2, 256**2), ("b", 1, 2, 256**2)]
    assert [abs(r[4]) for r in rows] == pytest.approx([1, 1, 1]) and rows[0][5] == pytest.approx(1)


def test_deviations_beyond_a_long_are_null(spark):
    frame = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 7.0])], "vec_id int, embedding array<float>")
    rows = whitening.whiten(frame).collect()
    assert len(rows) > 0 and all(r["deviation"] is None for r in rows if r["vec_id"] < 3)


def test_vectors_are_packed_without_loss():
    rng = np.random.default_rng(2)
    rows = [rng.integers(-(2 ** int(b)), 2 ** int(b), 5) for b in rng.integers(0, 63, 300)] + [np.array([0, 0, 256, 0, 0]), np.array([-(2**63), 2**63 - 1, 0, 0, 0]), np.zeros(5, np.int64), np.array([0, -1, 128, -128, 127])]
    keys = [whitening.packed_vector(x) for x in rows]
    assert (whitening.unpacked(keys, 5) == np.array(rows)).all()
    assert whitening.packed_vector(np.array([3, 0, 0])) == whitening.packed_vector(np.array([3]))


@pytest.mark.parametrize("tasks", [1, 40])
def test_tree_sum(spark, tasks):
    rows = spark.range(0, 1000, 1, tasks)
    total = tree_sum(rows, lambda it: sum((np.resize(b.column(0).to_numpy().sum(), 3) for b in it), np.zeros(1, np.int64)), np.int64)
    assert total.tolist() == [999 * 500] * 3
