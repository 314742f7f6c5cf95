import hashlib
import random

import numpy as np

from particula.llm import centroids as C


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x * scale) < C.HUGE for x in v):
            kept.append((i, [int(np.floor(np.float64(x) * scale)) for x in v]))
    order = sorted(kept, key=lambda x: (x[0] is None, "" if x[0] is None else hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    placed = [(i, *near(v)) for i, v in kept]
    own = {j: sum(d for _, d, c in placed if c == j) for j in range(k)}
    whole = sum(own.values())

    def fits(x):
        return x if x < 2**63 else None

    return sorted(((i, j, fits(d), fits(own[j]), fits(whole), cents[j]) for i, d, j in placed), key=str)


def got(df, **kw):
    return sorted(map(tuple, C.cluster(df, **kw).collect()), key=str)


def rows_of(n, dims, spread, seed):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(r.choice([-spread, 0, spread]), 1))) for _ in range(dims)]) for i in range(n)]
    bad = [None, [], [1.0] * (dims - 1), [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    return rows + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]


def test_against_brute_force(spark):
    for dims, k, kind in ((64, 8, "float"), (3, 5, "double")):
        rows = rows_of(150, dims, 2, dims)
        df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, id string").repartition(4)
        assert got(df, k=k, rounds=6, dims=dims) == brute(rows, k, 6, dims)


def test_wide_arithmetic(spark):
    """Distances and sums beyond 64 bits are right inside and null in the result; what fits no type takes no part."""
    rows = [(i, [float(x), float(-x)]) for i, x in enumerate([1e13, 1e13 + 4, -5e12, 3, 4, 5, 1e12])] + [(50, [1e200, 1.0]), (51, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 3, 4, 2)
    assert got(df, k=3, rounds=4, dims=2) == want and any(x[2] is None for x in want) and len(want) == 7


def test_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert got(empty, k=8, rounds=3) == []
    assert got(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>"), k=8, rounds=3) == []
    rows = [(1, [0.5, 0.5]), (2, [0.25, -0.75]), (2, [0.25, -0.75])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(df, k=8, rounds=3, dims=2) == brute(rows, 8, 3, 2)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(rows_of(20, 4, 1, 0), "vec_id long, embedding array<float>")
    plan = C.cluster(df, k=2, rounds=1, dims=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
