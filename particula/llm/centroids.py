"""Centroid clustering of integer vectors with JVM-native expressions only.

Method. A component x becomes floor(scale * x). The centroids are literal
arrays: ``zip_with`` and ``aggregate`` give a vector's squared distance to each,
``array_min`` of (distance, number) structs the nearest, ties going to the
smaller number. A round is one scan and one hash aggregate (a sum per column,
partial sums before the shuffle of k rows per task); the driver divides the k
sums, rounding down, and keeps k x dims integers. No Python runs on the data.

The arithmetic is exact. One aggregate measures the largest component and the
number of vectors first: if no distance and no sum of distances or components
can leave 64 bits, the columns are LONG, else DECIMAL(38, 0); the results are
the same where both can hold them.

Defined cases: vectors that are null, of another length, or with a component
that is null, NaN or infinite take no part, nor do those with a component of
more than ``HUGE`` after scaling, which no exact 64-component square fits. The
first centroids are the vectors with the smallest lower-case hex SHA-256 of
``<seed>:<id>``, rows with one id in the order of their components, null ids
last; with fewer vectors than k there are fewer centroids, with none the result
is empty. Repeated rows count each. A centroid without vectors stays as it is.
A distance or sum that leaves 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this take no part: 64 squared differences of twice its size still fit DECIMAL(38).
HUGE = 10**17
_LONG = 2**63 - 1
_WIDE = "decimal(38,0)"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of integers."""
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = (F.size(raw) == dims) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= HUGE))
    # case stops at the first condition that holds, so that null arrays never reach the components
    kept = df.select(F.col(id_col).alias("id"), F.when(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims), F.when(usable, raw)).alias("raw"))
    return kept.filter("raw is not null").select("id", F.transform("raw", lambda x: F.floor(x * scale)).alias("v"))


def _literal(centroid: list[int], kind: str) -> Column:
    """The centroid as one literal array; parsed from text, which spares a call to the JVM for every component."""
    return F.expr(f"cast(split('{','.join(map(str, centroid))}', ',') as array<{kind}>)")


def _squared(vector: Column, centroid: list[int], kind: str) -> Column:
    apart = F.zip_with(vector, _literal(centroid, kind), lambda a, b: ((a - b) * (a - b)).cast(kind))
    return F.aggregate(apart, F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))


def nearest(vector: Column, centroids: list[list[int]], kind: str) -> Column:
    """struct(distance, cluster) of the nearest centroid."""
    return F.array_min(F.array(*[F.struct(_squared(vector, c, kind).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]))


def _first(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [x.v for x in vectors.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()]


def _moved(vectors: DataFrame, centroids: list[list[int]], kind: str) -> list[list[int]]:
    """One round: every centroid that has vectors becomes their mean, rounded down."""
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in range(len(centroids[0]))]
    found = vectors.select("v", nearest(F.col("v"), centroids, kind)["cluster"].alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"), *sums)
    out = list(centroids)
    for row in found.collect():
        out[row.c] = [int(row[f"s{i}"]) // row.n for i in range(len(out[row.c]))]
    return out


def cluster(df: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid (its final components)."""
    vectors = whole_vectors(df, id_col, vector_col, dims, scale)
    largest, count = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.count(F.lit(1))).first()
    # a centroid may lie one below the smallest component, since means are rounded down
    largest = (largest or 0) + 1
    kind = "bigint" if max(count, 1) * dims * (2 * largest) ** 2 <= _LONG else _WIDE
    vectors = vectors.select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    centroids = _first(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(vectors, centroids, kind)
    centroids = [[int(x) for x in c] for c in centroids] or [[0] * dims]
    placed = vectors.select("id", nearest(F.col("v"), centroids, kind).alias("near"))
    inertia = {x.c: int(x.s) for x in placed.groupBy(F.col("near.cluster").alias("c")).agg(F.sum("near.distance").alias("s")).collect()}
    own, whole = [inertia.get(j, 0) for j in range(len(centroids))], sum(inertia.values())
    at = F.col("near.cluster") + 1

    def number(x: int) -> Column:
        return F.lit(x if x <= _LONG else None).cast("bigint")

    return placed.select(
        F.col("id").alias(id_col),
        F.col("near.cluster").alias("cluster"),
        F.expr("try_cast(near.distance as bigint)").alias("distance"),
        F.element_at(F.array(*map(number, own)), at).alias("cluster_inertia"),
        number(whole).alias("inertia"),
        F.element_at(F.array(*[_literal(c, "bigint") for c in centroids]), at).alias("centroid"),
    )


def oracle_sql(table: str, k: int, rounds: int, dims: int, scale: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding") -> str:
    """DuckDB text of ``cluster`` with the SHA-256 of the centroid: a round is an assignment and a mean per component."""
    steps = [
        f"""vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, {id_col} AS id, list_transform({vector_col}, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM {table}
  WHERE len({vector_col}) = {dims} AND len(list_filter({vector_col}, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS j, v AS c
  FROM (SELECT v, sha256('{seed}:' || CAST(id AS VARCHAR)) AS h FROM vecs ORDER BY h, v LIMIT {k}))""",
    ]
    near = """a{r} AS MATERIALIZED (
  SELECT rid, min(row(d, j)) AS near FROM (
    SELECT rid, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vecs, c{r}) GROUP BY rid)"""
    for r in range(rounds):
        steps.append(near.format(r=r))
        steps.append(f"""m{r} AS MATERIALIZED (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS c FROM (
    SELECT j, i, sum(x) AS s, count(*) AS n FROM (
      SELECT near[2] AS j, unnest(v) AS x, unnest(range({dims})) AS i FROM vecs JOIN a{r} USING (rid)) GROUP BY j, i) GROUP BY j)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.j = o.j)")
    steps.append(near.format(r=rounds))
    return f"""WITH {", ".join(steps)}
SELECT id AS {id_col}, j AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT id, CAST(near[2] AS INTEGER) AS j, near[1] AS d FROM vecs JOIN a{rounds} USING (rid)) JOIN c{rounds} USING (j)"""
