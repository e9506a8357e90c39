import numpy as np
import pytest

from corpusloom.llm.neighbours import Curves, hilbert_keys, similar_vectors


@pytest.mark.parametrize("d, bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_neighbours(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def clustered(n, dim, rng):
    centres = rng.standard_normal((n // 4, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.1 * rng.standard_normal((n, dim))).astype(np.float32)


def best(x, ids, k, least):
    c = cosines(x.astype(np.float64))
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-c[i, j], ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order if c[i, j] >= least}
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = clustered(1500, 16, rng)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, v array<float>")
    want = best(x, ids, 5, 0.9)
    got = {(r["id"], r["neighbour"]) for r in similar_vectors(df, "id", "v", 16, 5, 0.9, window=128).collect()}
    assert len(want & got) >= 0.97 * len(want) and got <= {(a, b) for a in ids for b in ids}
    all_want = best(x[:400], ids[:400], 5, -1)
    all_got = {(r["id"], r["neighbour"]) for r in similar_vectors(df.limit(400), "id", "v", 16, 5, window=128).collect()}
    assert len(all_want & all_got) >= 0.9 * len(all_want)


def test_unusable_rows_copies_and_ties(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0]), ("d", [2.0, 0.0]), ("e", [0.0, 0.0]), ("f", None), ("g", [1.0]), ("h", [None, 1.0]), (None, [1.0, 0.0]), ("i", [0.0, 1.0]), ("j", [float("nan"), 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "id string, v array<float>, rank int, cosine int")
    got = {(r["id"], r["neighbour"], r["rank"]) for r in similar_vectors(df, "id", "v", 2, 2, 0.9).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "b", 2)}
    assert similar_vectors(df.limit(0), "id", "v", 2).count() == 0


def test_curves_are_the_same_every_time():
    x = np.random.default_rng(1).standard_normal((5, 8)).astype(np.float32)
    assert (Curves(8, 2, 3).keys(x, 1) == Curves(8, 2, 3).keys(x, 1)).all()


def test_some_are_asked_against_all(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 12)).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, v array<float>")
    got = similar_vectors(df, "id", "v", 12, 5, window=200, every=10).collect()
    asked = {r["id"] for r in got}
    want = {p for p in best(x, ids, 5, -1) if p[0] in asked}
    assert 60 < len(asked) < 200 and len(got) == 5 * len(asked)
    assert len(want & {(r["id"], r["neighbour"]) for r in got}) >= 0.9 * len(want)


def test_a_floor_holds_where_windows_are_a_small_part(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((500, 48))
    away -= (away * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    x[-500:] = 0.95 * x[:500] + np.sqrt(1 - 0.95**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, v array<float>")
    got = {(r["id"], r["neighbour"]) for r in similar_vectors(df, "id", "v", 48, 5, 0.9, window=4).collect()}
    want = {p for i in range(500) for p in ((i, 19_500 + i), (19_500 + i, i))}
    assert len(want & got) >= 0.97 * len(want) and got <= want


def test_only_the_best_of_a_dense_cluster_are_kept(spark):
    rng = np.random.default_rng(6)
    x = (np.eye(1, 16) + 0.01 * rng.standard_normal((300, 16))).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, v array<float>")
    got = {(r["id"], r["neighbour"]) for r in similar_vectors(df, "id", "v", 16, 5, 0.9).collect()}
    assert len(got) == 1500 and len(got & best(x, ids, 5, 0.9)) >= 1440
