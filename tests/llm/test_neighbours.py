import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label string, score string, bucket string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "l", "s", "b") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, is_query):
    """Nearest of the usable vectors, in double precision of the stored floats."""
    ids = np.array([i for i, _ in vectors])
    matrix = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        scores = matrix @ matrix[q]
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_probes_come_in_order_and_once():
    place, distance = np.array([0.2, 3.7, -1.4]), 0.9
    cells = neighbours.probes(place, distance, 0.95)
    assert len({tuple(c) for c in cells}) == len(cells)
    assert cells[0].tolist() == np.floor(place).tolist()
    scaled = neighbours.WIDTH / distance
    chance = (neighbours._normal((cells + 1 - place) * scaled) - neighbours._normal((cells - place) * scaled)).prod(axis=1)
    assert (np.diff(chance) <= 1e-12).all() and chance[:-1].sum() < 0.95 <= chance.sum()


def test_estimated_success_is_met():
    random = np.random.default_rng(2)
    place, distance, hits = random.uniform(-5, 5, 4), 0.8, 0
    cells = {tuple(c) for c in neighbours.probes(place, distance, 0.8)}
    for _ in range(4000):
        moved = place + random.standard_normal(4) * distance / neighbours.WIDTH
        hits += tuple(np.floor(moved)) in cells
    assert abs(hits / 4000 - 0.8) < 0.04


@pytest.mark.parametrize("scale", [0.0, 0.8])
def test_recall_and_exact_scores(spark, scale):
    random = np.random.default_rng(4)
    vectors = [(i, random.standard_normal(24) * (1 + scale * random.random())) for i in range(1500)]
    vectors += [(2000 + i, vectors[3][1]) for i in range(300)]  # a hot bucket, full of ties
    got = found(neighbours.search(table(spark, vectors), F.col("vec_id") % 20 == 0, k=10))
    want = brute(vectors, 10, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)
    lookup = dict(vectors)
    for q, rows in got.items():
        a = np.float32(lookup[q]).astype(float)
        assert all(abs(s - a @ np.float32(lookup[i]).astype(float)) < 1e-9 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_blocks_do_not_change_results(spark, monkeypatch):
    random = np.random.default_rng(6)
    vectors = [(i, random.standard_normal(8)) for i in range(300)]
    whole = found(neighbours.search(table(spark, vectors), F.col("vec_id") % 20 == 0, k=5))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    cut = found(neighbours.search(table(spark, vectors), F.col("vec_id") % 20 == 0, k=5))
    assert {q: [i for i, _ in r] for q, r in whole.items()} == {q: [i for i, _ in r] for q, r in cut.items()}


def test_odd_vectors_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [1, 0]), (1, [2, 0]), (2, [0, 3]), (20, [1, 1]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]),
               (7, [1, None]), (8, []), (9, [1, 2, 3]), (None, [5, 5]), (40, None), (2, [0, 4])]
    got = found(neighbours.search(table(spark, vectors), F.col("vec_id") % 20 == 0, k=20))
    assert got == {0: [(1, 2.0), (20, 1.0), (2, 0.0)], 20: [(2, 3.0), (1, 2.0), (0, 1.0)]}
    assert neighbours.search(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.search(table(spark, [(0, [1, 2])]), F.col("vec_id") % 20 == 0).collect() == []
