"""One-class SVM (M2): the nu formulation with an RBF kernel, trained on all rows by Spark.

The kernel exp(-gamma |x - y|^2) is replaced by random Fourier features
z(x) = sqrt(2/D) cos(W x + b) (Rahimi & Recht 2007), so the machine is linear
in z. Its primal is

    min over w, rho:  1/2 |w|^2 - rho + 1/(nu n) sum max(0, rho - w.z_i)

For a given w the best rho is the nu-quantile of the scores w.z, and a
subgradient is w minus the mean z of the rows below it. Stepping along it with
averaging is the conditional-gradient method on the dual (Bach 2015). Its
corrective form is used: w is the shortest average of all means found so far,
which takes a tenth of the passes. The duality gap bounds the distance to the
optimum; training stops when that gap is a small share of |w|^2.

Work: the inputs (8 bytes a column and row) are persisted for the fit; z, D
numbers a row, is computed anew from them by numpy wherever a step needs it, as
it would not fit in memory. A step is one quantile and one mean; the driver
holds w and a sum per task (D numbers each). The last scoring is one pass of
column maths, no Python in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

ACCURACY = 10_000  # of the quantile: its rank is right to 1 / ACCURACY of the rows


def fourier(columns: int, gamma: float, components: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W (components x columns) and b of z(x)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 * gamma), size=(components, columns)), rng.uniform(0.0, 2.0 * math.pi, size=components)


def fourier_terms(columns: list[str], w: np.ndarray, b: np.ndarray) -> list[str]:
    """The components of z(x) as SQL texts over columns without missing values."""
    scale = math.sqrt(2.0 / len(b))
    inner = [" + ".join([f"{c!r}D", *(f"{x!r}D * `{n}`" for x, n in zip(row, columns, strict=True))]) for row, c in zip(w.tolist(), b.tolist(), strict=True)]
    return [f"{scale!r}D * cos({t})" for t in inner]


def _features(batch: pa.RecordBatch, terms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """z of a batch's rows; a row's numbers do not depend on the rows beside it."""
    w, b = terms
    inner = np.tile(b, (batch.num_rows, 1))
    for j in range(w.shape[1]):
        inner += batch.column(j).to_numpy()[:, None] * w[:, j]
    return math.sqrt(2.0 / len(b)) * np.cos(inner)


def _dot(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (z * w).sum(axis=1)


def _quantile(x: DataFrame, terms, w: np.ndarray, nu: float) -> float:
    """The nu-quantile of the scores w.z."""

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"s": _dot(_features(batch, terms), w)})

    return float(x.mapInArrow(scores, "s double").select(F.percentile_approx("s", nu, ACCURACY)).first()[0])


def _sums(x: DataFrame, terms, w: np.ndarray | None = None, rho: float = 0.0) -> dict[int, tuple[int, np.ndarray]]:
    """Count and sum of z over the rows scored below rho (-1) and at it (0); over all rows (0) without w."""

    def add(batches):
        found = {}
        for batch in batches:
            z = _features(batch, terms)
            side = np.zeros(len(z)) if w is None else np.sign(_dot(z, w) - rho)
            for of in (-1, 0):
                rows = z[side == of]
                if len(rows):
                    n, total = found.get(of, (0, 0.0))
                    found[of] = n + len(rows), total + rows.sum(axis=0)
        for of, (n, total) in found.items():
            yield pa.RecordBatch.from_pydict({"side": [of], "n": [n], "total": [total.tolist()]})

    out = {}
    for r in x.mapInArrow(add, "side long, n long, total array<double>").collect():  # two rows a task
        n, total = out.get(r["side"], (0, 0.0))
        out[r["side"]] = n + r["n"], total + np.array(r["total"])
    return out


def _tail_mean(x: DataFrame, terms, w: np.ndarray, rho: float, share: float) -> np.ndarray | None:
    """Mean feature vector of the ``share`` rows with the lowest scores; rows at the border count in part."""
    found = _sums(x, terms, w, rho)
    n_below, below = found.get(-1, (0, 0.0))
    n_at, at = found.get(0, (0, 0.0))
    rest = min(max(share - n_below, 0.0), n_at)
    if n_below + rest == 0:
        return None
    return (below + (rest * (at / n_at) if rest else 0.0)) / (n_below + rest)


def shortest_average(points: np.ndarray, most: int = 5000) -> np.ndarray:
    """The weighted average of a few points that lies nearest to the origin (pairs of weights are moved)."""
    gram = points @ points.T
    weight = np.zeros(len(points))
    weight[gram.diagonal().argmin()] = 1.0
    for _ in range(most):
        pull = gram @ weight
        to, of = int(pull.argmin()), int(np.where(weight > 0, pull, -np.inf).argmax())
        if pull[of] - pull[to] <= 1e-12 * gram.diagonal().max():
            break
        step = min((pull[of] - pull[to]) / (gram[to, to] + gram[of, of] - 2 * gram[to, of]), weight[of])
        weight[to], weight[of] = weight[to] + step, weight[of] - step
    return weight @ points


def fit(x: DataFrame, terms, n: int, nu: float, steps: int, tolerance: float) -> np.ndarray:
    """w for the persisted frame ``x`` of input columns, with ``terms`` (W, b) of z."""
    w = _sums(x, terms)[0][1] / n
    means = [w]
    for _ in range(steps):
        s = _tail_mean(x, terms, w, _quantile(x, terms, w, nu), nu * n)
        if s is None or float(w @ (w - s)) <= tolerance * float(w @ w):
            break
        means.append(s)
        w = shortest_average(np.array(means))
    return w


def one_class_svm(
    df: DataFrame, columns: list[str], nu: float = 0.05, components: int = 64, steps: int = 30, tolerance: float = 0.02, least: int = 5, seed: int = 42
) -> DataFrame:
    """``df`` with ``decision`` (w.z - rho) and ``is_anomaly`` (decision <= 0, about the share ``nu`` of the rows).

    gamma is 1 / (number of columns x variance of all their values). Missing
    and NaN values count as 0, as in the reproduced service. Fewer than
    ``least`` rows: nothing flagged, null decisions. Rows equal in all columns
    get the same answer.
    """
    names = [f"_x{i}" for i in range(len(columns))]
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(x) for c, x in zip(columns, names, strict=True)]
    inputs = df.select(*filled)
    found = inputs.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(x)).alias(f"{k}{x}") for x in names for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    n = found["n"]
    if n < least:
        return df.withColumn("decision", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    means = np.array([found[f"m{x}"] for x in names])
    variance = float(np.mean([found[f"v{x}"] for x in names]) + means.var())
    terms = fourier(len(names), 1.0 / (len(names) * max(variance, 1e-12)), components, seed)
    # the narrow inputs are dealt evenly first, as every step runs over them
    x = inputs.repartition(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w = fit(x, terms, n, nu, steps, tolerance)
        # as one sum, which is compiled; rho by the same sum, so that the row at the border scores 0 exactly
        score = F.expr(" + ".join(f"{float(v)!r}D * {t}" for v, t in zip(w, fourier_terms(names, *terms), strict=True)))
        rho = float(x.select(F.percentile_approx(score, nu, ACCURACY)).first()[0])
    finally:
        x.unpersist()
    scored = df.select("*", *filled).select(*[F.col(f"`{c}`") for c in df.columns], (score - F.lit(rho)).alias("decision"))
    return scored.withColumn("is_anomaly", F.col("decision") <= 0)

