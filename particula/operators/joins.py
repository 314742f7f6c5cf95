"""Join helpers. The physical strategy is left to the optimizer and AQE, which
broadcast a side only from its measured size and split skewed partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join on `on` where NULL keys match NULL keys; the key columns of `big` stay."""
    other = small.withColumnsRenamed({c: f"_right_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    joined = big.join(other, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{c}" for c in on])


def lookup_map(mapping: dict):
    """Literal map for fixed lookups (bounded by construction, no join needed)."""
    return F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
