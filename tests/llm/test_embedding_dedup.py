import numpy as np
import pytest

from siteloom.llm import embedding_dedup as E


def brute(rows):
    """(id: (links, component)) of distinct (id, vector) rows."""
    ok = {}
    for name, v in rows:
        if name is None or v is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            ok[name] = x / np.linalg.norm(x)
    ids = sorted(ok)
    links = {i: set() for i in ids}
    for dim in {len(x) for x in ok.values()}:
        own = [i for i in ids if len(ok[i]) == dim]
        m = np.array([ok[i] for i in own])
        for a, row in zip(own, m @ m.T >= 0.95, strict=True):
            links[a] |= {own[j] for j in np.flatnonzero(row)} - {a}
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += links[j]
    return {i: (len(links[i]), comp[i]) for i in ids}


def clustered(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n // 10):
        c = r.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(r.integers(1, 20)):
            e = r.normal(size=dim)
            out.append((c + r.choice(spread) * e / np.linalg.norm(e)).astype(np.float32).tolist())
    return out


@pytest.mark.parametrize("seed,dim", [(1, 64), (2, 24)])
def test_recall_and_precision(spark, seed, dim):
    rows = list(enumerate(clustered(seed, 400, dim, [0.0, 0.05, 0.15, 0.22, 0.3])))
    want = brute(rows)
    got = {r["vec_id"]: r for r in E.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    links = sum(v[0] for v in want.values())
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * links > 0
    same = sum(got[i]["component_id"] == want[i][1] for i in want)
    assert same >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_large_group_makes_few_pairs(spark):
    rows = list(enumerate(clustered(3, 10, 64, [0.02]) * 1))
    r = np.random.default_rng(4)
    c = r.normal(size=64)
    rows += [(1000 + i, (c + 0.1 * r.normal(size=64)).astype(np.float32).tolist()) for i in range(600)]
    want = brute(rows)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in E.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.1]), (10, [1.0, 0.1]), (11, [3e38, 3e38]), (12, [1.0, 1.0])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, cell int")
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(spark, frame).collect())
    want = brute(rows)
    assert got == sorted((-1 if i is None else i, *(want.get(i) or (0, i)), i is None or (want.get(i) or (0, i))[1] == i) for i, _ in rows)
    assert E.near_vectors(spark, frame.limit(0)).count() == 0
