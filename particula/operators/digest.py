"""Exact cooldown digest (ST7) in batch, as DataFrame operations.

A digest is sent when an alert arrives at least `cooldown` after the previous
digest (the first alert always sends one); it summarises every alert since
the previous digest. Sequentially that is a scan over all alerts of a key;
here it is computed without gathering them:

1. successor: for every alert, the first alert at least `cooldown` later.
   With time buckets of length `cooldown`, an alert's threshold falls in the
   next bucket, so one window per (key, bucket) over the bucket's alerts and
   the previous bucket's thresholds finds it; thresholds with no match there
   take the first alert of the next non-empty bucket (a small table).
2. boundaries: the digests are the chain first -> successor -> successor ...
   Consecutive digests are >= cooldown apart, so there is at most one per
   bucket. Buckets in a row make a block of at most `BLOCK_ROWS` alerts (their
   density is measured). A task follows the successors inside its block by
   pointer doubling on arrays, for all alerts at once, to the first alert
   beyond the block. The chain over blocks is then short; it is enumerated by
   jump tables of 1, 2, 4, ... steps on the few alerts that blocks lead to,
   and each block lists its digests from the alert that enters it.
3. membership: an alert belongs to the first digest at or after it, which is
   in its block, or the successor of the block's last digest, or (for a block
   that no digest falls in) the entry of a later block; the same task tells.

A window's task holds one bucket of one key (plus the thresholds of the
previous bucket), a block's task at most `BLOCK_ROWS` alerts or one bucket;
helper tables scale with buckets, not alerts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C

#: Alerts of a block; one bucket is never cut.
BLOCK_ROWS = 1_000_000
OUT_COLS = [
    "digest_key", "sent_at", "total_alerts", "high_alerts", "medium_alerts", "low_alerts", "top_high", "more_high",
    "deliver",
]


def _prepared(alerts: DataFrame, key, cooldown_us: int) -> DataFrame:
    k = F.lit("all") if key is None else F.col(key).cast("string")
    return alerts.select(
        k.alias("k"),
        F.unix_micros("timestamp").alias("t"),
        F.col("alert_id").alias("id"),
        "severity",
        F.concat(F.col("sensor_id"), F.lit(": "), F.col("alert_type")).alias("label"),
    ).withColumn("b", F.expr(f"(t - pmod(t, {cooldown_us}L)) div {cooldown_us}L"))


def _first_from(rows: DataFrame, marks: DataFrame, value: str, after: bool = False) -> DataFrame:
    """For each (k, b) in `marks`, the first `value` of `rows` in a bucket >= b, or > b.

    One window over the union of both small tables, per key, backwards by
    bucket with the marks behind or ahead of the rows of their own bucket: a
    running frame is one pass, one that looks ahead reads its rest at every row.
    """
    u = rows.select("k", "b", F.lit(0).alias("kind"), F.col(value).alias("v")).unionByName(
        marks.select("k", "b", F.lit(1 if after else -1).alias("kind"), F.lit(None).cast(rows.schema[value].dataType).alias("v"))
    )
    backwards = Window.partitionBy("k").orderBy(F.desc("b"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        u.withColumn("n", F.last("v", ignorenulls=True).over(backwards))
        .filter(F.col("kind") != 0)
        .select("k", "b", "n")
    )


def successors(a: DataFrame, cooldown_us: int) -> DataFrame:
    """(k, b, t, id, severity, label) -> the same without b, and nid, nt: the first alert at least `cooldown` later."""
    probes = a.select(
        "k",
        (F.col("b") + 1).alias("b"),
        (F.col("t") + F.lit(cooldown_us)).alias("t"),
        F.lit(0).alias("kind"),
        F.struct("id", "severity", "label").alias("src"),
        F.lit(None).cast("string").alias("id"),
    )
    data = a.select("k", "b", "t", F.lit(1).alias("kind"), F.lit(None).cast(probes.schema["src"].dataType).alias("src"), "id")
    # from the last row back, as a running frame (see _first_from)
    backwards = Window.partitionBy("k", "b").orderBy(F.desc("t"), F.desc("kind"), F.desc("id")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    nxt = F.last(F.when(F.col("kind") == 1, F.struct("t", "id")), ignorenulls=True).over(backwards)
    found = probes.unionByName(data).select("k", "b", "t", "kind", "src", nxt.alias("n")).filter(F.col("kind") == 0)
    found = found.withColumn("t", F.col("t") - F.lit(cooldown_us))

    hit = found.filter(F.col("n").isNotNull()).select(
        "k", "src.*", "t", F.col("n.id").alias("nid"), F.col("n.t").alias("nt")
    )
    miss = found.filter(F.col("n").isNull()).select("k", "b", "t", "src")
    # no later alert in the threshold's bucket: continue at the first alert of
    # the next non-empty bucket, resolved once per distinct bucket
    first = a.groupBy("k", "b").agg(F.min(F.struct("t", "id")).alias("f"))
    resolved = _first_from(first, miss.select("k", "b").distinct(), "f", after=True)
    miss = miss.join(resolved, ["k", "b"], "left").select(
        "k", "src.*", "t", F.col("n.id").alias("nid"), F.col("n.t").alias("nt")
    )
    return hit.unionByName(miss)


def _bucket(t: str, length: int):
    """Which stretch of `length` a whole number falls in, rounded down."""
    return F.expr(f"({t} - pmod({t}, {length}L)) div {length}L")


def _steps(block: pa.Table) -> np.ndarray:
    """Position of each alert's successor in the block, -1 where it is beyond."""
    return pc.fill_null(pc.index_in(block["nid"], value_set=block["id"], skip_nulls=True), -1).to_numpy().astype(np.int64)


def _exits(block: pa.Table) -> pa.Table:
    """For every alert of a block, the first alert beyond it that the successors lead to."""
    step = _steps(block)
    end = np.where(step < 0, np.arange(len(step)), step)
    while not np.array_equal(end, end[end]):
        end = end[end]
    return pa.table({"k": block["k"], "id": block["id"], "nid": block["nid"].take(pa.array(end)), "nt": block["nt"].take(pa.array(end))})


def _owners(block: pa.Table) -> pa.Table:
    """The alerts of a block with their digest: the first one at or after them, from the block's entry on."""
    block = block.sort_by([("t", "ascending"), ("id", "ascending")])
    entry = block["entry"][0].as_py()
    own = np.full(block.num_rows, -1, np.int64)
    following = (entry["t"], entry["id"])
    at = pc.index(block["id"], entry["id"]).as_py()
    if at >= 0:
        step, digests = _steps(block).tolist(), []
        while at >= 0:
            digests.append(at)
            at = step[at]
        place = np.searchsorted(digests, np.arange(len(own)))
        own = np.append(digests, -1)[place]
        following = (block["nt"][digests[-1]].as_py(), block["nid"][digests[-1]].as_py())
    pick = pa.array(own, mask=own < 0)
    d_t = pc.fill_null(block["t"].take(pick), pa.scalar(following[0], pa.int64()))
    d_id = pc.fill_null(block["id"].take(pick), pa.scalar(following[1], block.schema.field("id").type))
    return pa.table({**{c: block[c] for c in ("k", "t", "id", "severity", "label")}, "d_t": d_t, "d_id": d_id})


def memberships(a: DataFrame, succ: DataFrame, cooldown_us: int) -> DataFrame:
    """The alerts (k, t, id, severity, label) that a digest summarises, with that digest's alert (d_t, d_id)."""
    from ..session import cut_lineage

    density = a.groupBy("k", "b").count().agg(F.max("count").alias("most"), F.min("b").alias("low"), F.max("b").alias("high")).first()
    length = max(1, BLOCK_ROWS // (density["most"] or 1))
    start = a.groupBy("k").agg(F.min(F.struct("t", "id")).alias("s"))
    chain = start.select("k", F.col("s.id").alias("id"), F.col("s.t").alias("t"))
    block = _bucket(f"(t - pmod(t, {cooldown_us}L)) div {cooldown_us}L", length)
    links = cut_lineage(succ.withColumn("block", block))
    blocks = 0 if density["low"] is None else density["high"] // length - density["low"] // length + 1
    if blocks > 1:
        chain = cut_lineage(chain)
        exits = links.groupBy("k", "block").applyInArrow(_exits, "k string, id string, nid string, nt long")
        exits = cut_lineage(exits)
        # only alerts that blocks lead to, and the first ones, can enter a block
        entries = exits.select("k", F.col("nid").alias("id")).unionByName(chain.select("k", "id")).distinct()
        jump = cut_lineage(exits.join(entries, ["k", "id"], "left_semi"))
        levels = math.ceil(math.log2(blocks + 1))
        for level in range(levels):
            # chain holds positions 0 .. 2^level - 1; one jump of 2^level steps doubles it
            step = jump.join(chain.select("k", "id"), ["k", "id"], "left_semi")
            chain = (
                chain.unionByName(step.select("k", F.col("nid").alias("id"), F.col("nt").alias("t")))
                .filter(F.col("id").isNotNull())
                .distinct()
            )
            chain = cut_lineage(chain)
            if level + 1 < levels:
                j2 = jump.select("k", F.col("id").alias("nid"), F.col("nid").alias("nid2"), F.col("nt").alias("nt2"))
                jump = cut_lineage(
                    jump.join(j2, ["k", "nid"], "left").select("k", "id", F.col("nid2").alias("nid"), F.col("nt2").alias("nt"))
                )
    entered = chain.select("k", block.alias("b"), F.struct("t", "id").alias("entry"))
    # a block that no digest falls in belongs to the next entry
    entered = _first_from(entered, links.select("k", F.col("block").alias("b")).distinct(), "entry")
    entered = entered.filter(F.col("n").isNotNull()).select("k", F.col("b").alias("block"), F.col("n").alias("entry"))
    owned = links.join(entered, ["k", "block"]).groupBy("k", "block").applyInArrow(
        _owners, "k string, t long, id string, severity string, label string, d_t long, d_id string"
    )
    return owned.filter(F.col("d_id").isNotNull())


def digest_chain(
    alerts: DataFrame, cooldown_minutes: float = C.DIGEST_COOLDOWN_MINUTES, key=None, top: int = C.DIGEST_TOP_HIGH
) -> DataFrame:
    """ST7 batch: the digests the cooldown rule sends, with their summaries."""
    cooldown_us = int(cooldown_minutes * C.MICROS_PER_MINUTE)
    from ..session import cut_lineage

    # read several times below; a checkpoint, unlike a cache, needs no release
    a = cut_lineage(_prepared(alerts, key, cooldown_us))
    succ = successors(a, cooldown_us)
    tagged = cut_lineage(memberships(a, succ, cooldown_us)).withColumn("d", F.struct(F.col("d_t").alias("t"), F.col("d_id").alias("id")))

    summary = tagged.groupBy("k", "d").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "HIGH").alias("high_alerts"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium_alerts"),
        F.count_if(F.col("severity") == "LOW").alias("low_alerts"),
    )
    rank = F.row_number().over(Window.partitionBy("k", "d").orderBy("t", "id"))
    tops = (
        tagged.filter(F.col("severity") == "HIGH")
        .withColumn("r", rank)
        .filter(F.col("r") <= top)
        .groupBy("k", "d")
        .agg(F.sort_array(F.collect_list(F.struct("r", "label"))).alias("tl"))  # at most `top` rows per digest
    )
    out = summary.join(tops, ["k", "d"], "left")
    return out.select(
        F.col("k").alias("digest_key"),
        F.timestamp_micros(F.col("d.t")).alias("sent_at"),
        "total_alerts",
        "high_alerts",
        "medium_alerts",
        "low_alerts",
        F.coalesce(F.transform("tl", lambda x: x["label"]), F.array().cast("array<string>")).alias("top_high"),
        F.greatest(F.col("high_alerts") - F.lit(top), F.lit(0)).cast("bigint").alias("more_high"),
        (F.col("high_alerts") > 0).alias("deliver"),
    )
