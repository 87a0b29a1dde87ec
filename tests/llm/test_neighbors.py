import numpy as np
import pytest

from lavra.llm import neighbors

SCHEMA = "passagem_id long, modelo string, vetor array<float>, cosseno string"


def brute(rows, k, least):
    seen = {}
    for i, m, v, _ in rows:
        if i is not None and m is not None and v and all(x is not None for x in v) and any(v):
            seen[i] = (m, np.asarray(v, np.float64) / np.linalg.norm(v))
    groups = {}
    for i, (m, v) in seen.items():
        groups.setdefault((m, len(v)), []).append((i, v))
    out = set()
    for group in groups.values():
        ids = np.asarray([i for i, _ in group])
        cosines = np.round(np.stack([v for _, v in group]) @ np.stack([v for _, v in group]).T, 9)
        for a, i in enumerate(ids):
            near = sorted((-cosines[a, b], ids[b]) for b in np.flatnonzero(cosines[a] >= least) if b != a)[:k]
            out |= {(int(min(i, j)), int(max(i, j))) for _, j in near}
    return out


def made(n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = [(i, "m", [float(x) for x in v], None) for i, v in enumerate(base.astype(np.float32))]
    for k in range(n // 4):  # near copies, scaled
        v = base[k] / np.linalg.norm(base[k]) + rng.standard_normal(dim) * 0.05
        rows.append((n + k, "m", [float(x) for x in (3 * v).astype(np.float32)], None))
    return rows


def test_recall_with_many_cells(spark):
    rows = made(3000)
    got = {tuple(r) for r in neighbors.similar_pairs(spark.createDataFrame(rows, SCHEMA), cell=128).collect()}
    want = brute(rows, 10, 0.9)
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_copies_and_edges(spark):
    rows = made(200)
    rows += [(5000 + i, "m", rows[0][2], "x") for i in range(300)]  # a third of all rows are copies of one
    rows += [(9000, "m", None, None), (9001, "m", [], None), (9002, "m", [0.0] * 24, None), (9003, None, rows[0][2], None), (9004, "m", [1.0, None], None), (None, "m", rows[0][2], None), (9005, "m", rows[0][2][:8], None), (9006, "o", rows[0][2], None), (5, "m", rows[5][2], None)]
    got = {tuple(r) for r in neighbors.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 10, 0.9)


def test_order_and_ties(spark):
    rows = [(i, "m", [1.0, 0.0], None) for i in range(5)] + [(9, "m", [1.0, 0.1], None)]
    got = [(r["vizinha"], r["posicao"]) for r in neighbors.nearest(spark.createDataFrame(rows, SCHEMA), k=3).where("passagem_id = 9").orderBy("posicao").collect()]
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_empty(spark):
    assert neighbors.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probabilities_add_up():
    tree = neighbors.Tree(np.random.default_rng(0).standard_normal((500, 8)).astype(np.float32), 3, 0)
    _, _, mass, home = tree.visits(np.ones((5, 8), np.float32), 0.4)
    assert home.sum() == 5 and 0 < mass.sum() <= 5.001


def test_family_of_near_equal_vectors(spark):
    """More partners than k whose cosines differ by less than half floats can tell."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    family = [(i, "m", [float(x) for x in (centre + 0.003 * rng.standard_normal(64)).astype(np.float32)], None) for i in range(150)]
    got = {tuple(r) for r in neighbors.similar_pairs(spark.createDataFrame(family, SCHEMA)).collect()}
    assert got == brute(family, 10, 0.90)


def recall(spark, vectors, **limits):
    rows = [(i, "m", [float(x) for x in v], None) for i, v in enumerate(np.asarray(vectors, np.float32))]
    got = {tuple(r) for r in neighbors.similar_pairs(spark.createDataFrame(rows, SCHEMA), **limits).collect()}
    want = brute(rows, 10, 0.9)
    return len(got & want) / len(want), len(got - want) / len(want)


@pytest.mark.parametrize("noise", [0.001, 0.01, 0.03])
def test_dense_cluster_over_many_cells(spark, noise):
    """Many more partners at the least similarity than k, some apart from them, and cells that cut the cluster."""
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(32)
    centre /= np.linalg.norm(centre)
    found, wrong = recall(spark, np.concatenate([centre + noise * rng.standard_normal((2000, 32)), rng.standard_normal((300, 32))]), cell=128)
    assert found >= 0.95 and wrong <= 0.05


@pytest.mark.parametrize("dim", [2, 3, 8])
def test_low_dimension(spark, dim):
    found, wrong = recall(spark, np.random.default_rng(dim).standard_normal((2500, dim)), cell=128)
    assert found >= 0.95 and wrong <= 0.05


def test_parts_of_cells_and_turns_of_indexes(spark, monkeypatch):
    rows = made(600) + [(10_000 + i, f"m{j}", v, None) for j in range(3) for i, (_, _, v, _) in enumerate(made(40 + j, seed=j))]
    rows = [(k, m, v, x) for k, (_, m, v, x) in enumerate(rows)]
    want = brute(rows, 10, 0.9)
    monkeypatch.setattr(neighbors, "SAMPLE_LEAST", 16)
    monkeypatch.setattr(neighbors, "PER_CELL", 1)
    got = {tuple(r) for r in neighbors.similar_pairs(spark.createDataFrame(rows, SCHEMA), cell=32, indexes=2).collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want
