import math

import numpy as np
import pytest

from logmill.llm import ann
from logmill.llm.ann import CentroidGraph, balanced_centroids, search


def brute(rows, k=10):
    """Nearest others of each row whose id is divisible by 100."""
    own = sorted({(i, tuple(np.float64(v))) for i, v in rows})
    ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own])
    out = {}
    for i, v in own:
        if i % 100 == 0:
            best = {}
            for j, d in zip(ids.tolist(), np.sqrt(((x - np.array(v)) ** 2).sum(axis=1)).tolist()):
                if j != i:
                    best[j] = min(d, best.get(j, d))
            out[i] = sorted((d, j) for j, d in best.items())[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'x' AS score", "2 AS list")


def test_exact_where_one_list_holds_all(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-2, 3, 5) + 0.5) for i in range(0, 400)]  # many equal distances and equal vectors
    rows += [(1000 + i, np.full(5, 2.5)) for i in range(150)]
    assert found(search(table(spark, rows))) == brute(rows)


def test_recall_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 64)
    monkeypatch.setattr(ann, "LEAST_ENTRIES", 40)
    monkeypatch.setattr(ann, "BLOCK", 50)
    r = np.random.default_rng(2)
    centers = r.normal(size=(20, 16)) * 2
    rows = [(i, np.float32(centers[r.integers(20)] + r.normal(size=16))) for i in range(4000)]
    rows += [(5000 + i, rows[7][1]) for i in range(800)]
    got, want = found(search(table(spark, rows))), brute(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]) >= 0.9
    for q in got:
        exact = dict((j, d) for d, j in brute(rows, 5000)[q]) if q < 300 else {}
        assert all(math.isclose(exact[j], d, rel_tol=1e-12, abs_tol=1e-12) for d, j in got[q] if exact)
    assert all(got[q] == want[q] for q in got if q >= 5000)


@pytest.mark.parametrize(("kind", "share"), [("clustered", 0.1), ("independent", 0.8)])
def test_recall_of_the_pruned_lists(kind, share):
    """With the operator's own parameters: what the lists that queries open hold of the true neighbours, and of all entries."""
    r = np.random.default_rng(1)
    n = 20_000
    x = r.normal(size=(n, 64))
    if kind == "clustered":
        x += 2 * r.normal(size=(200, 64))[r.integers(200, size=n)]
    graph = CentroidGraph.of(balanced_centroids(x, ann.LIST))
    boundary, ratio, most = ann.learned(graph, x, 10)
    some = [ann.postings(graph, boundary, x[a : a + 500]) for a in range(0, n, 500)]
    rows, lists = np.concatenate([rows + 500 * k for k, (rows, _) in enumerate(some)]), np.concatenate([lists for _, lists in some])
    assert n < len(rows) <= ann.COPIES * n
    sizes = np.bincount(lists, minlength=len(graph.points))
    queries = np.arange(0, n, 100)
    of, opened = ann.probes(graph, sizes, ratio, most, x[queries])
    held = []
    for k, q in enumerate(queries):
        d = ((x - x[q]) ** 2).sum(axis=1)
        found = set(rows[np.isin(lists, opened[of == k])].tolist())
        held.append(np.mean([j in found for j in np.argsort(d)[1:11].tolist()]))
    assert np.mean(held) >= 0.9
    assert ann.share_compared(graph, sizes, ratio, most, x[queries], n) <= share


def test_graph_finds_the_nearest():
    r = np.random.default_rng(3)
    points, queries = r.normal(size=(500, 8)), r.normal(size=(60, 8))
    near, far = CentroidGraph.of(points).search(queries, 32)
    d = np.sqrt(((queries[:, None] - points) ** 2).sum(axis=2))
    exact = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(near, exact)]) > 0.95
    assert np.allclose(far, np.take_along_axis(d, near, axis=1))
    assert all(len(set(a)) == len(a) for a in near.tolist())
    sizes = balanced_centroids(np.vstack([r.normal(size=(3000, 4)), np.ones((900, 4))]), 50)
    assert 60 <= len(sizes) <= 400


@pytest.mark.parametrize("few", [0, 1, 3])
def test_edges(spark, few):
    bad = [(0, None), (100, []), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0]), (600, [1.0])]
    rows = [(700, [1.0, 2.0]), (700, [1.0, 2.0]), (8, [1.0, -0.0])][:few] if few else []
    df = spark.createDataFrame(bad + rows, "vec_id long, embedding array<float>")
    if few:
        df = df.unionByName(spark.createDataFrame([(9000 + 1, [5.0, 5.0]), (9000 + 3, [5.0, 0.0])], "vec_id long, embedding array<float>"))
    got = found(search(df.where("vec_id is null or vec_id <> 600 or size(embedding) <> 1") if not few else df))
    if not few:
        assert got == {}
    else:
        assert list(got) == [700]
        assert [j for _, j in got[700]] == ([8, 9003, 9001] if few == 3 else [9003, 9001])
