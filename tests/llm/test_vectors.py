"""Embedding links against all pairs, and the bounds of tiles against plain products."""

import numpy as np

from chronopanel.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(seed=0, n=160, dim=12):
    rng = np.random.default_rng(seed)
    rows, centers = [], rng.standard_normal((12, dim))
    for i in range(n):
        c = centers[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.0, 0.01, 0.05, 0.3])
        rows.append((i, (c * rng.uniform(0.5, 3)).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    rows += [(600, None, 1), (601, [0.0] * dim, 1), (602, [float("nan")] * dim, 1), (603, [None] + [1.0] * (dim - 1), 1), (604, rows[0][1], None)]
    rows += [(605, [float("inf")] * dim, 0), (606, [], 0), (607, [1.0, 2.0], 0), (608, [2.0, 4.0], 0), (None, rows[0][1], rows[0][2]), rows[3], rows[3]]
    return rows


def plain(rows, threshold=0.98):
    good = []
    for _, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        good.append(np.array(v, float) / np.sqrt(np.dot(np.array(v, float), np.array(v, float))) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, front = {i}, [i]
        while front:
            for j in near[front.pop()]:
                if j not in group:
                    group.add(j), front.append(j)
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            out[k] = (rows[k][0], len(near[k]), min(ids) if ids else None)
    return sorted(((a, b, c, a == c) for a, b, c in out), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_links_and_components(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    for size in (16, 1024):
        got = sorted((tuple(r) for r in V.linked(df, tile=size).select("vec_id", "n_links", "component_id", "kept").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert got == want


def test_empty_and_unsound(spark):
    assert V.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    one = V.linked(spark.createDataFrame([(7, None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(7, 0, 7, True)]


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 40)) * np.linspace(2, 0.1, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[rng.permutation(300)[:200]] + rng.standard_normal((200, 40)) * 0.02
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for t in (0.5, 0.9, 0.98):
        assert (V.close_pairs(x, y, t) == (x @ y.T >= t)).all()
