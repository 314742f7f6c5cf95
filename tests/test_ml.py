"""ML detectors: planted outliers, determinism, flagged share, dispatch errors."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from particula.operators import ml as ML
from particula.operators.one_class import one_class_svm
from particula.operators.series import aligned_series
from particula.plans.learning import trailing_ratio

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        pm10 = rnd.uniform(10, 60)
        t, h = rnd.uniform(10, 25), rnd.uniform(30, 70)
        pm25 = 0.5 * pm10 + rnd.gauss(0, 1.0)
        rows.append((i, "sensor-urban-0", T0 + dt.timedelta(minutes=i), pm25, pm10, t, h))
    for j, i in enumerate(range(400, 406)):  # planted: pm2_5 far off the pm10 relation
        pm10, t, h = rnd.uniform(10, 60), rnd.uniform(10, 25), rnd.uniform(30, 70)
        rows.append((i, "sensor-urban-0", T0 + dt.timedelta(minutes=i), 400.0 + j, pm10, t, h))
    return spark.createDataFrame(
        rows, "event_id long, sensor_id string, timestamp timestamp, pm2_5 double, pm10 double, temperature double, humidity double"
    )


def _flagged(df):
    return {r.event_id for r in df.filter("is_anomaly").select("event_id").collect()}


def test_random_forest_flags_planted(planted):
    out = ML.random_forest_residual(planted)
    flagged = _flagged(out)
    assert set(range(400, 406)) <= flagged
    assert len(flagged) < 40
    assert flagged == _flagged(ML.random_forest_residual(planted))  # fixed seed


def test_kmeans_minority_is_planted_cluster(planted):
    flagged = _flagged(ML.kmeans_minority(planted))
    assert flagged == set(range(400, 406))


def test_one_class_share_and_planted(planted):
    out = one_class_svm(planted, ML.FEATURES, nu=0.05)
    flagged = _flagged(out)
    share = len(flagged) / planted.count()
    assert 0.03 <= share <= 0.08
    assert len(set(range(400, 406)) & flagged) >= 5


def _exact_one_class(x, nu, gamma, sweeps=4000):
    """Flags of the kernel machine itself: the dual solved by pairs of most violating rows."""
    n = len(x)
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    top = 1.0 / (nu * n)
    a = np.zeros(n)
    a[: int(nu * n)] = top
    a[int(nu * n)] = 1.0 - a.sum()
    score = k @ a
    for _ in range(sweeps):
        up, down = np.where(a < top - 1e-12, score, np.inf).argmin(), np.where(a > 1e-12, score, -np.inf).argmax()
        if score[down] - score[up] < 1e-7:
            break
        step = min((score[down] - score[up]) / (2 - 2 * k[up, down]), top - a[up], a[down])
        a[up], a[down] = a[up] + step, a[down] - step
        score += step * (k[:, up] - k[:, down])
    return score <= np.quantile(score, nu)


def test_one_class_against_the_exact_machine(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(0, 1, (280, 2)), r.normal(6, 0.5, (100, 2)), r.uniform(-12, 14, (20, 2))])
    gamma = 1.0 / (2 * x.var())
    exact = _exact_one_class(x, 0.05, gamma)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "event_id long, a double, b double")
    flagged = _flagged(one_class_svm(df, ["a", "b"], nu=0.05, components=512, tolerance=0.002, steps=60))
    same = sum(bool(e) == (i in flagged) for i, e in enumerate(exact)) / len(x)
    both = len(flagged & set(np.flatnonzero(exact).tolist())) / exact.sum()
    assert same >= 0.97 and both >= 0.75, (same, both)


def test_one_class_missing_values_and_equal_rows(spark):
    rows = [(i, 1.0, 2.0) for i in range(50)] + [(50, None, 2.0), (51, float("nan"), 2.0), (52, 0.0, 2.0)]
    out = one_class_svm(spark.createDataFrame(rows, "event_id long, decision double, b double").select("event_id", F.col("decision").alias("a"), "b"), ["a", "b"]).collect()
    by_id = {r.event_id: round(r.decision, 9) for r in out}
    assert len({by_id[i] for i in range(50)}) == 1 and by_id[50] == by_id[51] == by_id[52]


def test_detect_dispatch_and_errors(spark, planted):
    with pytest.raises(ValueError):
        ML.detect(planted, "nope")
    with pytest.raises(ValueError):
        ML.random_forest_residual(planted.drop("humidity"))
    out = ML.detect(planted, "kmeans", hours=1)  # look-back: the last hour before the newest reading
    assert out.count() == 61
    resp = ML.response(ML.detect(planted, "kmeans", hours=None)).first()
    assert resp.readings == 406 and resp.anomalies == 6


def test_per_group_hook(spark, planted):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        z = (pdf.pm2_5 - pdf.pm2_5.mean()) / pdf.pm2_5.std()
        return pd.DataFrame({"event_id": pdf.event_id, "flag": z.abs() > 3})

    out = ML.per_group(planted, fn, "event_id long, flag boolean", bucket_minutes=24 * 60)
    assert {r.event_id for r in out.filter("flag").collect()} >= set(range(400, 406))


def test_small_inputs_flag_nothing(spark, planted):
    one = planted.limit(1)
    for m in ("random-forest", "svm", "kmeans"):
        out = ML.detect(one, m, hours=None)
        assert out.filter("is_anomaly").count() == 0


def test_pages_put_together_are_the_series(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *[T0 + dt.timedelta(seconds=37 * k) for k in range(200)]]), rnd.choice([None, float(i)]), rnd.random() < 0.1) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, sensor_id string, timestamp timestamp, pm2_5 double, is_anomaly boolean").repartition(5)
    for bucket in (1, None):
        got = {}
        for r in sorted(aligned_series(df, values=("pm2_5",), page_rows=17, bucket_minutes=bucket).collect(), key=lambda r: (str(r.sensor_id), r.page)):
            assert r.readings == len(r.timestamps) == len(r.pm2_5) == len(r.scores) <= 17
            have = got.setdefault(r.sensor_id, ([], [], [], [0]))
            assert len(have[0]) == 17 * r.page
            for part, new in zip(have, (r.timestamps, r.pm2_5, r.scores), strict=False):
                part.extend(new)
            have[3][0] += r.anomalies
        for sensor in ("a", "b", None):
            own = sorted((r for r in rows if r[1] == sensor), key=lambda r: (r[2] is not None, r[2] or T0, r[0]))
            flagged = {r[2] for r in own if r[4]}
            assert got[sensor] == ([r[2] for r in own], [r[3] for r in own], [int(r[2] in flagged) for r in own], [sum(r[4] for r in own)])
    assert aligned_series(df.limit(0), values=("pm2_5",)).collect() == []


def test_hook_with_context_equals_the_ungrouped_detector(spark, planted):
    whole = trailing_ratio(planted.toPandas().assign(is_context=False))
    rows = planted.select("event_id", "sensor_id", "timestamp", "pm2_5")
    schema = "event_id long, sensor_id string, pm25_avg double, is_anomaly boolean"
    want = {r.event_id: (round(r.pm25_avg, 9), r.is_anomaly) for r in whole.itertuples()}
    for bucket in (5.0, 7.0, 60.0, None):
        got = ML.per_group(rows, trailing_ratio, schema, bucket_minutes=bucket, context_minutes=5.0).collect()
        assert len(got) == len(want) and {r.event_id: (round(r.pm25_avg, 9), r.is_anomaly) for r in got} == want
    with pytest.raises(ValueError):
        ML.per_group(rows, trailing_ratio, schema, bucket_minutes=4.0, context_minutes=5.0)


def test_forest_takes_each_row_once_in_sums_per_cell(spark):
    """No walk of all rows per level: a pass over the rows leaves a row per tree and cell, whatever their number."""
    from particula.operators import forest

    rows = [(float(i % 4 * 10 + i % 3), float(i % 4), float(i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    got = {(r.a, r.b): r.p for r in forest.forest_predictions(df, 2000, "y", ["a", "b"], 1, 30, 1, "p").distinct().collect()}
    assert len(got) == 28
    for (a, b), p in got.items():
        assert abs(p - np.mean([r[0] for r in rows if r[1:] == (a, b)])) < 0.5  # one tree tries all features
    sums = df.selectExpr("CAST(a AS INT) AS cell", "y").coalesce(1).mapInArrow(forest._weighted_sums(4, 30, 1), "tree int, cell int, w double, wy double, wyy double")
    assert sums.count() == 30 * 4
    assert 0.95 < sums.agg(F.sum("w")).first()[0] / (30 * 2000) < 1.05


def test_a_tree_finds_the_cells_means():
    from particula.operators.forest import grown

    bins = list(np.unravel_index(np.arange(12), [4, 3]))
    y = np.arange(12) ** 2.0
    w = np.arange(12) % 3 + 1.0
    p = grown(bins, [4, 3], np.array([w, w * y, w * y * y]), 2, 30, np.random.default_rng(0))
    assert np.allclose(p, y)


def test_cuts_of_few_and_many_values():
    from particula.operators.forest import cuts_of

    assert cuts_of([1.0, 1.0, 2.0, 4.0]) == [1.5, 3.0]
    assert cuts_of([5.0, 5.0]) == []
    assert len(cuts_of(range(1000))) == 31


def test_one_class_keeps_the_inputs_only(planted, monkeypatch):
    from particula.operators import one_class

    kept, was = [], one_class.fit
    monkeypatch.setattr(one_class, "fit", lambda x, *more: kept.append(x.dtypes) or was(x, *more))
    out = one_class_svm(planted, ML.FEATURES, nu=0.05)
    assert out.where("decision = 0").count() == 1  # the border row, whose flag no rounding may turn
    assert kept == [[(f"_x{i}", "double") for i in range(4)]]


def test_kmeans_starts_share_their_passes(planted, monkeypatch):
    passes, was = [], ML._moved
    monkeypatch.setattr(ML, "_moved", lambda starts: passes.append(len(starts)) or was(starts))
    assert _flagged(ML.kmeans_minority(planted)) == set(range(400, 406))
    assert passes[0] == ML.KMEANS_STARTS and len(passes) <= 20
