"""Ball k-means beside plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm.ball_codes import Balls, Space, compress, digest, with_label_error

DDL = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(rows, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error)} and the books, every part compared with every entry."""
    kept = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    step = width // parts
    cut = [[v[k * step:(k + 1) * step] for k in range(parts)] for _, v in kept]
    seeds = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0], kept[j][1]))[:entries]
    books = [[list(cut[j][k]) for j in seeds] for k in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(p[k], c)), e) for e, c in enumerate(books[k]))
                 for k in range(parts)] for p in cut]

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [p[k] for p, f in zip(cut, found) if f[k][1] == e]
                if mine:
                    books[k][e] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, assign())], books


def table(spark, rows):
    return spark.createDataFrame([(i, v, n % 3 or None, "c", "e") for n, (i, v) in enumerate(rows)], DDL)


def vectors(seed, n, dim, spread=1.0):
    pick = random.Random(seed)
    return [(i, [float(np.float32(pick.gauss(pick.randrange(3), spread))) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("rows,entries", [
    (vectors(1, 150, 8), 16), (vectors(2, 60, 8, 0.001), 40),
    ([(i, [float(i % 3), 0.0, float(i % 2), 1.0]) for i in range(40)], 8),  # many ties and equal entries
    (vectors(3, 20, 6) + [(50, [1.0, 2.0]), (51, []), (52, None), (53, [float("nan")] * 6), (54, [float("inf")] * 6),
                          (55, [None] * 6), (3, [9.0] * 6), (3, [9.0] * 6), (None, [0.5] * 6)], 30),
    ([(i, [1e12 * (i % 5), -3e11 * i, 0.5, 7.0]) for i in range(12)], 4),  # beyond 64-bit products
])
def test_beside_plain_rounds(spark, rows, entries):
    expected, books = plain(rows, entries=entries)
    codes, found = compress(table(spark, rows), entries=entries)
    ours = [(r.vec_id, r.code, r.error) for r in codes.collect()]
    expected = [(i, c, min(e, (1 << 63) - 1)) for i, c, e in expected]
    assert sorted(map(str, ours)) == sorted(map(str, expected))
    assert [[list(map(int, e)) for e in b] for b in found] == books


def test_label_errors_put_nulls_together(spark):
    codes, _ = compress(table(spark, vectors(4, 30, 4)), entries=4)
    rows = with_label_error(codes).collect()
    assert len(rows) == 30
    for row in rows:
        assert row.label_error == sum(r.error for r in rows if r.label == row.label)


def test_empty(spark):
    codes, books = compress(table(spark, []).where("false"))
    assert with_label_error(codes).count() == 0 and digest(books) == hashlib.sha256(b"").hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=12),
       st.lists(st.tuples(st.integers(-8, 8), st.integers(-8, 8), st.integers(0, 11)), min_size=1, max_size=40))
def test_rings_lose_nothing(entries, points):
    for largest in (8, 1 << 28, 1 << 40):  # each kind of number
        space = Space(2, largest)
        balls = Balls(np.array(entries), space)
        xs, codes = space.of(np.array([p[:2] for p in points])), np.array([p[2] % len(entries) for p in points])
        found, squared = balls.nearest(xs, codes)
        for (x, y, _), c, d in zip(points, found, squared):
            assert (int(d), c) == min(((x - a) ** 2 + (y - b) ** 2, e) for e, (a, b) in enumerate(entries))
