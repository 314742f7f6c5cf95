"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Method. Every shard prefers the table's slots in an order of its own: it starts
at an offset and goes on by a fixed step, both from a hash of its name, and as
the table's size is prime it comes to every slot once. The shards take turns,
each claiming the first slot in its order that is still free, until the table
is full. A key's place is the shard that owns the slot of its hash. Shares
differ by one slot at most, and when a shard goes away few keys move between
the others.

The table has ``size`` rows whatever the data, so it is broadcast; a key costs
one hash and one lookup, no shuffle, and hot keys cost nothing more.

Defined cases: a null key is placed like the empty text; equal keys have equal
places; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime, a hundred times the usual number of shards at least.
SIZE = 8191
#: Hex digits of a key's MD5 that are taken as its number: 60 bits.
DIGITS = 15


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The owner (index in ``shards``) of every slot."""
    if not shards or len(set(shards)) < len(shards) or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("distinct shards and a prime size of at least their number are needed")
    at = [number(f"{s} offset") % size for s in shards]
    step = [number(f"{s} step") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % size
        owner[at[i]] = i
    return owner


def table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard): the lookup table; ``size`` rows."""
    rows = [(slot, shards[i]) for slot, i in enumerate(fill(shards, size))]
    return spark.createDataFrame(rows, "slot long, shard string")


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key's text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long"), F.lit(size)).alias("slot")


def place(rows: DataFrame, key_col: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``rows`` with the columns slot and shard added (in place of such columns, if there are any)."""
    owners = table(rows.sparkSession, shards, size)
    return rows.withColumn("slot", slot(F.col(key_col), size)).drop("shard").join(F.broadcast(owners), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def oracle_sql(shards: list[str], size: int, source: str, key: str) -> str:
    """The table filled turn by turn in SQL, and the keys of ``source`` placed by it."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    n = len(shards)

    def hashed(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, {DIGITS}))::BIGINT"

    return f"""
WITH RECURSIVE shards(i, name) AS (VALUES {names}),
starts AS (SELECT list({hashed("name || ' offset'")} % {size} ORDER BY i) AS offsets,
                  list({hashed("name || ' step'")} % {size - 1} + 1 ORDER BY i) AS steps FROM shards),
turns AS (
  SELECT 0 AS turn, offsets AS next, steps, [false FOR x IN range({size})] AS taken, NULL::BIGINT AS slot FROM starts
  UNION ALL
  SELECT turn + 1, next, steps, taken, slot FROM (
    SELECT turn, steps, free AS slot,
           list_concat(list_concat(next[1:turn % {n}], [(free + steps[turn % {n} + 1]) % {size}]), next[turn % {n} + 2:]) AS next,
           list_concat(list_concat(taken[1:free], [true]), taken[free + 2:]) AS taken
    FROM (
      SELECT *, [s FOR s IN [(next[turn % {n} + 1] + j * steps[turn % {n} + 1]) % {size} FOR j IN range({size})] IF NOT taken[s + 1]][1] AS free
      FROM turns WHERE turn < {size}
    )
  )
),
owners AS (SELECT slot, name AS shard FROM turns JOIN shards ON i = (turn - 1) % {n} WHERE turn > 0),
keys AS (SELECT {key}, {hashed(f"coalesce({key}::VARCHAR, '')")} % {size} AS slot FROM {source})
SELECT {key}, keys.slot, shard FROM keys JOIN owners ON keys.slot = owners.slot
"""
