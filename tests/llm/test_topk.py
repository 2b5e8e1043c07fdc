"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
from siltstone.llm import topk as T


def brute(rows, k, every):
    """Every query row against every row of another id, with Python's integers; repeated rows count as often as they occur."""
    q = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in q if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for n, v in q if n == i for j, w in q if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def ranked(df, k=5):
    return sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in T.top_k(df, k).collect())


@pytest.mark.parametrize("tree,block", [(40, 16 << 20), (4096, 16 << 20), (40, 200)])
def test_matches_brute_force(spark, monkeypatch, tree, block):
    monkeypatch.setattr(T, "TREE", tree)
    monkeypatch.setattr(T, "PAGE", 8)
    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(1, 260)]
    rows += [(300 + i, [0.5] * 6) for i in range(120)]  # many equal vectors
    rows += [(500, [0.0] * 6), (550, [1.0, 2.0]), (600, None), (601, [1.0, None, 0.0]), (602, [float("nan")]), (603, [float("inf")]), (None, [1.0] * 6), (650, [])]
    rows += [(50, rows[49][1]), (50, [-1.0] * 6), (77, rows[76][1]), (77, rows[76][1]), (-50, [3.0] * 6)]  # repeated rows and ids
    df = spark.createDataFrame([(i, v, 0.0, 1) for i, v in rows], "vec_id long, embedding array<double>, score double, rank int")
    assert ranked(df) == brute(rows, 5, 50)


def test_components_of_any_size(spark):
    """Beyond what floating point adds up exactly; beyond a long there is no score."""
    rows = [(50, [1e6, 0.0]), (1, [6e5, 1.0]), (2, [7e5, 1.0]), (3, [7e5, 1.0 / 256]), (4, [-7e5, 2.0]), (100, [2.0**45, 3.0]), (5, [3.0, 2.0**21]), (6, [3.0, 2.0**21 + 1 / 256])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [r for r in rows if r[0] != 100]
    assert ranked(spark.createDataFrame(small, df.schema)) == brute(small, 5, 50)
    wide = [r for r in rows if r[0] in (100, 5, 6)]
    assert ranked(spark.createDataFrame(wide, df.schema)) == brute(wide, 5, 50)
    with pytest.raises(Exception, match="beyond a long"):
        T.top_k(spark.createDataFrame([(50, [1.0]), (3, [1e30])], df.schema)).collect()


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ranked(spark.createDataFrame([], schema)) == []
    assert ranked(spark.createDataFrame([(50, [1.0])], schema)) == []
    assert ranked(spark.createDataFrame([(50, []), (1, [])], schema)) == [(50, 1, 1, 0)]
    assert ranked(spark.createDataFrame([(50, [1.0]), (3, [0.5])], schema)) == [(50, 1, 3, 256 * 128)]


def test_session_is_left_as_it_was(spark):
    before = dict(spark.conf.getAll)
    ranked(spark.createDataFrame([(50, [1.0]), (3, [0.5])], "vec_id long, embedding array<float>"))
    assert dict(spark.conf.getAll) == before


def scored(vectors, tree=512, every=50):
    """Share of all (query, vector) pairs that are scored when the queries pass through a forest in the order of its trees."""
    top = float((vectors * vectors).sum(1).max())
    points = T.lift(vectors, top)
    pivots = points[np.linspace(0, len(points) - 1, -(-len(points) // tree)).astype(int)]
    gap = np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(2))
    near = gap.argmin(1)
    order = np.lexsort((gap[np.arange(len(points)), near], near))
    ids = np.arange(len(vectors))
    trees = [T.Tree.from_bytes(T.Tree(ids[g], vectors[g], top).to_bytes()) for p in range(len(pivots)) for g in np.array_split(order[near[order] == p], max(1, -(-(near == p).sum() // tree))) if len(g)]
    floor = np.full(len(vectors), -np.inf)
    for t in trees:
        own = np.flatnonzero(t.ids % every == 0)
        q = T.Queries(t.ids[own], t.vectors[own].astype(float), np.full(len(own), -np.inf), top, 5)
        t.search(q, np.arange(len(own)))
        floor[t.ids[own]] = q.best[:, -1]
    asked = ids[ids % every == 0]
    q = T.Queries(asked, vectors[asked], floor[asked], top, 5)
    for t in trees:
        t.search(q, np.arange(len(asked)))
    exact = vectors[asked] @ vectors.T
    exact[np.arange(len(asked)), asked] = -np.inf
    assert np.array_equal(q.best, -np.sort(-exact, axis=1)[:, :5])
    return q.scored / (len(asked) * len(vectors))


def test_clustered_vectors_are_mostly_skipped():
    """Many nodes, many clusters: whole trees and pages beyond a query's reach are never scored."""
    r = np.random.default_rng(0)
    centres = r.normal(0, 1, (40, 16))
    centres *= 2000 / np.linalg.norm(centres, axis=1)[:, None]
    v = np.floor(centres[r.integers(0, 40, 10000)] + r.normal(0, 40, (10000, 16)))
    assert scored(v) < 0.06


def test_embeddings_of_the_test_table():
    """These lie nearly at random in 64 dimensions, where the balls of any metric tree overlap: few pairs can be skipped."""
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert scored(np.floor(256 * np.stack(d["embedding"]).astype(float))) <= 1.0
