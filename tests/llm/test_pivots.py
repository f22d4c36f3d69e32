import numpy as np
import pytest

from tessera.llm import pivots


@pytest.mark.parametrize("block", [2048, 16])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[5] + rng.normal(size=(60, 16)) * 0.12
    x[260:300] = x[rng.integers(0, 200, 40)] * 3 + rng.normal(size=(40, 16)) * 0.3
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[7].tolist()), (401, x[7].tolist()), (None, x[9].tolist()), (402, (x[9] * 2).tolist())]
    bad = [(500, None), (501, [0.0] * 16), (502, [None] + [1.0] * 15), (503, [float("nan")] * 16), (504, [float("inf")] + [1.0] * 15), (505, []), (506, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in vectors + bad], "vec_id long, embedding array<double>, digest string")
    rows = pivots.near_duplicates(df).collect()
    assert len(rows) == len(vectors) + len(bad)
    got = {r.vec_id: r for r in rows}
    y = np.array([v for _, v in vectors])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i, _ in vectors) >= 0.98 * near.sum()
    assert all(got[i].n_links <= k for (i, _), k in zip(vectors, near.sum(1), strict=True))
    ids = np.array([-1 if i is None else i for i, _ in vectors])
    component = ids.copy()
    for _ in ids:
        component = np.minimum(component, np.where(near, component[None], 10**9).min(1))
    same = [(-1 if got[i].component_id is None else got[i].component_id) == c for (i, _), c in zip(vectors, component, strict=True)]
    assert np.mean(same) > 0.98
    for i, _ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivots.near_duplicates(df.limit(0)).count() == 0
    assert pivots.near_duplicates(df.where("vec_id >= 500")).count() == len(bad)


def test_pivots_are_apart():
    x = np.random.default_rng(0).normal(size=(50, 8))
    x[:30] = x[0] + np.random.default_rng(1).normal(size=(30, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(pivots.spread(x, 20)) == 20 and (pivots.spread(x, 20) @ x[0] > 0.95).sum() == 1


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0, 2.0, float(i % 2)]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [1.0, 2.0, 0.0, 0.0]), (13, [1e-300, 2e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (2, i % 2) for i in range(6)} | {10: (2, 10), 11: (2, 10), 12: (0, 12), 13: (2, 10)}
