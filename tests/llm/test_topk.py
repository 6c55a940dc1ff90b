from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import topk

DDL = "vec_id long, embedding array<float>"


def brute(rows, asks, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if asks(q):
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, mod, **options):
    got = topk.top_k(spark.createDataFrame(rows, DDL), is_query=F.col("vec_id") % mod == 0, **options)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shard_rows", [16, 64, 4096])
def test_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.3, 8)).tolist()) for i in range(400)]
    assert run(spark, rows, 10, shard_rows=shard_rows, query_rows=13) == brute(rows, lambda q: q % 10 == 0)


def test_ties_copies_and_gaps(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, None), (101, []), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 0.0]), (200, [1.0, 2.0, 3.0]), (201, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    assert run(spark, rows, 20, shard_rows=8, query_rows=2) == brute(rows, lambda q: q % 20 == 0)


def test_few_rows_huge_values_and_empty(spark):
    rows = [(0, [1.0]), (1, [-2.0])]
    assert run(spark, rows, 1) == [(0, 1, 1, -131072), (1, 1, 0, -131072)]
    assert run(spark, [(0, [3e30]), (1, [3e30])], 2) == [(0, 1, 1, 2**63 - 1)]
    assert run(spark, [], 1) == [] and run(spark, [(1, None)], 1) == []
    big = [(i, [1e6 * (i + 1), 3.0]) for i in range(8)]
    assert run(spark, big, 2) == brute(big, lambda q: q % 2 == 0)


def test_shared_scores_beyond_doubles():
    """200 ties at 2^53 + 3, with that score as the floor: the smaller ids are found."""
    q = np.array([[1.0, 1.0]])
    x = np.array([[2.0**53, 3.0]] * 200)
    found = topk.search_block(x, np.arange(200), q, np.array([-1]), [2**53 + 3], 5)
    assert sorted(i for _, i, _ in found) == [0, 1, 2, 3, 4] and {s for *_, s in found} == {2**53 + 3}
    assert topk.search_block(x, np.arange(200), q, np.array([-1]), [2**53 + 4], 5) == []
    assert len(topk.search_block(-x * 2.0**20, np.arange(200), q, np.array([-1]), [-(2**63)], 5)) == 5


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 7, "x") for i in range(10)], DDL + ", score int, shard string")
    got = topk.top_k(df, is_query=F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_branches_are_pruned():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 3, (4000, 4)) * 256)
    s = topk._Search(topk.BallTree(x), np.arange(4000), x[:5] * 3, np.arange(5), [None] * 5, 5)
    s.walk(0, np.arange(5))
    assert s.visited < 5 * 4000 / 3
