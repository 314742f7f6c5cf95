import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from particula.llm import maglev, prefix_forest, url_filter


# ------------------------------------------------------------ prefix forest


def _brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % 3 == 0:
            s = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in ok if i != q)
            out[q] = s[:k]
    return out


def _vectors(n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    rows += [(n + i, rows[4][1]) for i in range(40)] + [(n + 50, None), (n + 51, []), (n + 52, [0.0] * 8), (n + 53, [1.0] * 7 + [float("nan")]), (n + 54, [None] + [1.0] * 7), (n + 55, [1.0] * 3), (None, [1.0] * 8), (n + 57, [float("inf")] * 8)]
    return rows


def test_whole_shards_as_candidates_give_the_exact_result(spark):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int").repartition(4)
    want = _brute(rows, 5)
    for shard_rows in (10_000, 50):
        got = {}
        for x in prefix_forest.nearest(df, F.col("id") % 3 == 0, share=1.0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
        assert got.keys() == want.keys()
        for q, found in got.items():
            assert [i for _, i, _ in found] == [i for _, i in want[q]] and [k for k, _, _ in found] == [1, 2, 3, 4, 5]
            assert all(abs(s + w) < 1e-12 for (_, _, s), (w, _) in zip(found, want[q], strict=True))


def test_recall_of_the_forest(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in prefix_forest.nearest(df, F.col("id") % 50 == 0, shard_rows=1500).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 4000, 50):
        s = x @ x[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / (5 * 80) >= 0.9


def test_candidates_share_the_longest_prefixes():
    r = np.random.default_rng(5)
    x = r.standard_normal((500, 16))
    forest = prefix_forest.Forest(x, trees=4, bits=10)
    strings = forest.strings(x)
    for q in range(0, 500, 37):
        common = np.array([[10 - int(a ^ b).bit_length() for b in row] for a, row in zip(strings[:, q], strings, strict=True)]).max(axis=0)
        for enough in (1, 20, 200, 500):
            level = next(v for v in range(10, -1, -1) if (common >= v).sum() >= enough)
            assert forest.candidates(strings[:, q], enough).tolist() == np.flatnonzero(common >= level).tolist()


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert prefix_forest.nearest(spark.createDataFrame([], schema), F.col("id") >= 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], schema)
    got = prefix_forest.nearest(two, F.col("id") >= 0).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == [(0, 1, 1, 1.0), (1, 1, 0, 1.0)]


def _all_pairs(rows, k):
    """Ranked lists of each query row, every other row a candidate; vectors of one length meet."""
    out = []
    for a, (q, v) in enumerate(rows):
        if q % 2 == 0:
            found = []
            for b, (i, w) in enumerate(rows):
                if a != b and len(v) == len(w):
                    x, y = (np.array(z) / max(map(abs, z)) for z in (v, w))
                    found.append((-float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())), i))
            out.append((q, [(i, round(-s, 12)) for s, i in sorted(found, key=lambda t: (round(t[0], 12), t[1]))[:k]]))
    return sorted(out)


def test_huge_components_repeated_ids_and_lengths(spark):
    big, tiny = 1e200, 1e-300
    rows = [(0, [big, big]), (1, [1.0, 0.0]), (2, [tiny, 0.0]), (3, [5e-324, 0.0]), (4, [1.7e308, -1.7e308])]
    rows += [(6, [1.0, 2.0]), (6, [2.0, 1.0]), (6, [2.0, 1.0]), (6, [4.0, 2.0]), (7, [2.0, 1.0])]
    rows += [(8, [1.0, 2.0, 3.0]), (9, [3.0, 2.0, 1.0]), (10, [1.0])]
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "embedding array<double>, vec_id long, row string").repartition(3)
    got = {}
    for x in prefix_forest.nearest(df, F.col("id") % 2 == 0, k=3, shard_rows=2).collect():
        got.setdefault((x.query_id, x.copy), []).append((x.rank, x.vec_id, round(x.score, 12)))
    flat = sorted((q, r, i, s) for (q, _), found in got.items() for r, i, s in found)
    want = sorted((q, r + 1, i, s) for q, found in _all_pairs(rows, 3) for r, (i, s) in enumerate(found))
    assert flat == want


# ------------------------------------------------------------ shard placement


def _fill(shards, size):
    """Turns played one by one."""
    taken, turn = {}, 0
    at = [0] * len(shards)
    while len(taken) < size:
        i = turn % len(shards)
        start, step = maglev.number(f"{shards[i]} offset") % size, maglev.number(f"{shards[i]} step") % (size - 1) + 1
        while (start + at[i] * step) % size in taken:
            at[i] += 1
        taken[(start + at[i] * step) % size] = i
        turn += 1
    return [taken[s] for s in range(size)]


def test_fill_is_even_and_stable():
    names = [f"s{i}" for i in range(7)]
    owner = maglev.fill(names, 701)
    assert owner == _fill(names, 701)
    counts = [owner.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = maglev.fill(names[:-1], 701)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 701
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            maglev.fill(bad, 701)
    with pytest.raises(ValueError):
        maglev.fill(names, 700)


def test_place_agrees_with_sql(spark, scratch):
    names = [f"s{i}" for i in range(5)]
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (77, None)], "doc_id long, shard string")
    got = maglev.place(df, "doc_id", names, 101)
    df.write.parquet(f"{scratch}/t")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{scratch}/t/*.parquet')")
    want = duck.execute(maglev.oracle_sql(names, 101, "documents", "doc_id")).fetchall()
    assert sorted(((r.doc_id, r.slot, r.shard) for r in got.collect()), key=str) == sorted(want, key=str)
    assert maglev.place(df.limit(0), "doc_id", names, 101).collect() == []
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------ URL filter


def _cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [
    "http://a.example.net/en/1", "https://example.net/en/", "http://example.net/de/", "http://notexample.net/en/x", "https://X.EXAMPLE.com/de/9?x=/de/", "http://example.com/fr/", "http://b.org/fr/1", "http://org/fr/",
    "http://b.org/FR/1", "http://n.net", "http://n.net?x", "http://n.net/", "ftp://u@h.net:80/p#f", "nothing", "", None, "://h.org/fr/", "http://a://b.net/", "http://é.ÀB.net/ü?q", "http://x.net\n/y", "https://adult-bets.example.org/en/",
    "https://quiet.example.org/en/" + "a" * 20000,
]


def test_urls_against_brute_force(spark):
    model = url_filter.fit(url_filter.labelled_table(spark))
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], None)], "page_id long, url string, host string")
    got = url_filter.judge(df, model)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = _cut(URLS[r.page_id or 0])
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.probability >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0), model).collect() == []


def test_regression_against_numpy(spark):
    """The same ridge regression, on the same hashed counts, by Newton steps."""
    table = url_filter.labelled_table(spark)
    bits = 9
    model = url_filter.fit(table, bits=bits)
    cut = table.select(url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"), "label")
    rows = url_filter._features(cut, bits).collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows], float)
    grams = [url for url in url_filter.LABELLED]
    assert x.sum(axis=1).tolist() == [sum(max(len(t) + 2 - n + 1, 0) for t in _cut(u) for n in url_filter.GRAMS) for u, _ in grams]
    design = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(design.shape[1]), np.r_[np.full(x.shape[1], 0.01), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (p - y) / len(y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design / len(y) + np.diag(ridge) + 1e-12 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    own = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    assert np.abs(own - 1 / (1 + np.exp(-design @ w))).max() < 1e-3
