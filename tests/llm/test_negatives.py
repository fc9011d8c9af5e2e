"""Hard negatives against all products in Python's integers, and the intervals of codes against exact products."""

import math

import numpy as np
import pytest

from chronopanel.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rid string, score string, slot string"


def table(seed=0, n=700, dim=24):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((14, dim))
    rows = []
    for i in range(n):
        v = centers[rng.integers(14)] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.4, 1.0])
        rows.append((i, v.astype(np.float32).tolist(), 3 if rng.random() < 0.4 else int(rng.integers(10))))
    rows += [(1000 + i, rows[50][1], int(rng.integers(10))) for i in range(40)]  # copies over labels
    rows += [(2000, None, 1), (2050, [float("nan")] * dim, 1), (2100, [None] + [1.0] * (dim - 1), 1), (2150, rows[0][1], None), (2200, [float("inf")] * dim, 0)]
    rows += [(2250, [0.0] * dim, 3), (2300, [-x for x in rows[0][1]], rows[0][2]), (2350, [1.0, 2.0], 4), (2351, [1.0, 2.0], 4), (2353, [0.6, 1.2], 5), (2400, [], 3), (2401, [], 3), (2402, [], 4)]
    rows += [(None, rows[50][1], 2), (None, rows[100][1], 5), rows[50], rows[50], rows[3]]  # null keys, repeated rows
    rows += [(2450, [3e6] * dim, 8), (2451, [2.9e6] * dim, 8), (2452, [2e6] * dim, 9)]  # beyond exact doubles
    return rows


def plain(rows):
    good = []
    for i, v, label in (r[:3] for r in rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(good):
        if i is None or i % 50:
            continue
        met = [(-max(-N.SCORE, min(N.SCORE, sum(a * b for a, b in zip(v, w)))), j is None, j or 0, m == label) for h, (j, m, w) in enumerate(good) if h != k and len(w) == len(v)]
        for p, none, j, _ in sorted(x for x in met if x[3])[:5]:
            fits = [x for x in met if not x[3] and 50 * -p <= 100 * -x[0] <= 95 * -p]
            out += [(i, None if none else j, r + 1, None if x[1] else x[2], -p, -x[0]) for r, x in enumerate(sorted(fits)[:3])]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [(64, 5), (8192, 1024)])
def test_against_all_products(spark, block):
    rows = table()
    got = N.mined(frame(spark, rows), block).collect()
    want = plain(rows)
    assert len(want) > 100
    assert sorted((tuple(r) for r in got), key=str) == want


def test_ties_go_to_smaller_ids(spark):
    rows = [(50, [1.0, 0.0], 1), *[(i, [1.0, 0.0], 1) for i in range(1, 6)], *[(i, [0.8, 0.0], 2) for i in (19, 12, 15, 11)]]
    got = N.mined(frame(spark, rows)).collect()
    assert sorted({(r.positive_id, r.rank, r.negative_id) for r in got}) == [(p, r, n) for p in (1, 2, 3, 4, 5) for r, n in ((1, 11), (2, 12), (3, 15))]


def test_empty_and_alone(spark):
    assert N.mined(frame(spark, [])).count() == 0
    assert N.mined(frame(spark, [(0, [1.0], 1)])).count() == 0
    assert N.mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)])).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_the_products(dim):
    rng = np.random.default_rng(dim)
    v = np.floor(rng.standard_normal((400, dim)) * rng.choice([1, 50, 300], (400, 1)))
    bits, align, rest = N.coded(v)
    wide, words = N.widened(v), bits.shape[2] * 64
    assert np.allclose(np.sqrt(rest[:, 0] ** 2 + align[:, 0] ** 2 * words), np.linalg.norm(wide, axis=1))
    for q in v[:20]:
        a, estimate, miss, x = N.Anchor(q), 0.0, 0.0, N.widened(q[None])
        for level in range(N.LEVELS):
            x = N.turned(x, level)
            signs = np.unpackbits(bits[:, level].copy().view(np.uint8), axis=1, bitorder="little").astype(float) * 2 - 1
            dots = a.dots(np.ascontiguousarray(bits[:, level]), level)
            assert (np.abs(dots - signs @ x[0]) <= a.miss[level] + 1e-6).all()
            estimate, miss = estimate + align[:, level] * dots, miss + align[:, level] * a.miss[level]
            assert (np.abs(v @ q - estimate) <= miss + a.length * rest[:, level] + 1e-6).all()
    assert rest[:, -1].mean() < rest[:, 0].mean() / 3  # four codes leave a small part of a vector
