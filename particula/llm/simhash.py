"""SimHash near-duplicates: 64-bit fingerprints of word shingles and a tiled exact comparison by exclusive-or and bit counts.

Method. Equal fingerprints are one class from the start (its smallest id stands
for it). Two fingerprints within the radius r agree exactly on at least
``CHUNKS - r`` of ``CHUNKS`` bit ranges, so every choice of that many ranges
gives a key under which they meet; only fingerprints under one key are
compared. Under a key they are sorted by population count and cut into tiles;
a tile is compared with a later one by numpy exclusive-or and bit counts unless
the keys differ or the population counts are further apart than the radius.
Keys with more than ``HOT_ROWS`` fingerprints are split into blocks by
population count and a salt, and each pair of blocks that may hold a link is a
task group of its own. The comparison is exact: no link is lost and none is
estimated. Links leave a task as a spanning forest of what the task saw, never
as all pairs of a group.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; fewer words than a shingle are one shingle;
rows that share an id are one node, and each keeps its row; a row without an
id gets the component of its own fingerprint class, if another row has an id
there, and adds no link; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from particula.session import cut_lineage

from . import textkernel as K
from .components import components

SEED = 42
TILE = 256
#: Bit ranges that a fingerprint is cut into; with radius r, CHUNKS - r of them agree.
CHUNKS = 4
#: Rows under one key that one task compares; larger keys are split into blocks of about this size.
HOT_ROWS = 16384
_ROWS_AT_ONCE = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each of the 64 bits set, lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprint_piece(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    low = K.LOWER[data]
    starts, ends, first = K.words(low, off, K.NOT_SPACE)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    # the words joined by single spaces, so that a shingle is one stretch of bytes
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    take = np.ones(at[-1], np.int64)
    take[0] = starts[0]
    take[at[1:-1]] = starts[1:] - ends[:-1]
    source = np.cumsum(take)
    gap = at[1:] - 1
    source[gap] = 0
    joined = low[np.minimum(source, len(low) - 1)]
    joined[gap] = 32
    joined = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    at = at.tolist()
    for d in range(len(off) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if a == b:
            continue
        last = max(b - shingle + 1, a + 1)
        counts, n = np.zeros(64, np.int64), last - a
        for i in range(a, last, _ROWS_AT_ONCE):
            j = min(i + _ROWS_AT_ONCE, last)
            hashes = np.fromiter((digest(joined[at[k] : at[min(k + shingle, b)] - 1], SEED) for k in range(i, j)), np.uint64, j - i)
            counts += _bit_counts(hashes)
        out[d] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): a bit is set if it is set in over half the XXH64 hashes (seed 42) of the shingles, repeats included."""

    def run(batches):
        for batch in batches:
            parts = [_fingerprint_piece(data, off, shingle) for _, _, data, off in K.pieces(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return K.short_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(K.tidy(run), schema)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links with the same connected components as the links (a, b) among n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _tile_links(key: np.ndarray, fp: np.ndarray, count: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within the radius under one key. Rows are sorted by (key, count).

    ``side``: 0 for a key that is compared with itself; 1 and 2 for the two blocks of
    a split key, of which only pairs across count.
    """
    n, left, right = len(fp), [], []
    for a in range(0, n, TILE):
        a_end = min(a + TILE, n)
        for b in range(a, n, TILE):
            b_end = min(b + TILE, n)
            if key[b] != key[a_end - 1] or (key[a] == key[b] and count[b] > count[a_end - 1] + radius):
                # the tiles share no key, or all later population counts are out of reach
                if b > a:
                    break
            near = np.bitwise_count(fp[a:a_end, None] ^ fp[None, b:b_end]) <= radius
            near &= key[a:a_end, None] == key[None, b:b_end]
            near &= (side[a:a_end, None] != side[None, b:b_end]) | (side[a:a_end, None] == 0)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            ahead = i < j
            i, j = i[ahead], j[ahead]
            if len(i) > 2 * TILE:
                top = b_end - a if b == a else 2 * TILE
                # rows of the two tiles are numbered from 0 for the small forest
                base_i, base_j = i - a, j - a if b == a else j - b + TILE
                u, v = _forest(max(top, 2 * TILE), base_i, base_j)
                back = lambda x: x + a if b == a else np.where(x < TILE, x + a, x - TILE + b)
                i, j = back(u), back(v)
            left.append(i)
            right.append(j)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _compare(radius: int):
    """Streams rows sorted by (key, count); a key's rows stay together, several small keys form one comparison."""

    def links(held: list[pa.RecordBatch], rows: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).slice(0, rows)
        key, fp, node, side = (table.column(c).to_numpy() for c in ("key", "fp", "node", "side"))
        fp = fp.view(np.uint64)
        a, b = _tile_links(key, fp, np.bitwise_count(fp).astype(np.int16), side, radius)
        if len(a):
            nodes, place = np.unique(node, return_inverse=True)
            a, b = _forest(len(nodes), place[a], place[b])
            a, b = nodes[a], nodes[b]
        else:
            a = b = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n = sum(b.num_rows for b in held)
            if n < _ROWS_AT_ONCE:
                continue
            key = np.concatenate([b.column("key").to_numpy() for b in held])
            done = int(np.searchsorted(key == key[-1], True))  # rows are grouped: the last key may go on
            if done:
                yield links(held, done)
                held = pa.Table.from_batches(held).slice(done).combine_chunks().to_batches()
        if held:
            yield links(held, sum(b.num_rows for b in held))

    return run


def _keys(radius: int):
    """The bit ranges chosen for each key: (mask, number)."""
    cuts = [64 * i // CHUNKS for i in range(CHUNKS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    agree = max(CHUNKS - radius, 0)
    return [sum(masks[i] for i in pick) for pick in combinations(range(CHUNKS), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, radius: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(u, v): links between nodes whose fingerprints differ in at most ``radius`` bits, as spanning forests.

    ``classes``: (fp long, node long), one row for each distinct fingerprint.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in _keys(radius)])
    keyed = classes.select("fp", "node", F.bit_count("fp").alias("pc"), F.posexplode(masks).alias("pick", "mask")).select(
        "fp", "node", "pc", F.xxhash64("pick", F.col("fp").bitwiseAND(F.col("mask"))).alias("base")
    )
    sizes = keyed.groupBy("base", "pc").agg(F.count("*").alias("n"))
    # keys that are too large for one task: few rows, one for each population count under such a key
    hot_keys = sizes.groupBy("base").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pc", "n")).alias("parts")).where(F.col("total") > hot_rows)
    hot_keys = hot_keys.select(
        "base",
        F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), F.floor(p["n"] / hot_rows).cast("int")), lambda s: F.struct(p["pc"].alias("pc"), s.alias("salt"))))).alias("blocks"),
    )
    joined = keyed.join(hot_keys, "base", "left")
    cold = joined.where("blocks IS NULL").select(F.col("base").alias("key"), "fp", "node", F.lit(0).cast("byte").alias("side"), "pc")
    # a row of a large key goes to every pair of its block with a block whose counts are in reach
    hot = joined.where("blocks IS NOT NULL").withColumn("salts", F.size(F.filter("blocks", lambda b: b["pc"] == F.col("pc"))))
    hot = hot.withColumn("own", F.struct("pc", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt")))
    hot = hot.withColumn("other", F.explode(F.filter("blocks", lambda b: F.abs(b["pc"] - F.col("pc")) <= radius))).withColumn("other", F.struct(F.col("other.pc").alias("pc"), F.col("other.salt").alias("salt")))
    hot = hot.select(
        F.xxhash64("base", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        "fp",
        "node",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
        "pc",
    )
    rows = cold.unionByName(hot).repartition(F.col("key")).sortWithinPartitions("key", "pc").select("key", "fp", "node", "side")
    return rows.mapInArrow(K.tidy(_compare(radius)), "u long, v long")


def _marked(rows: DataFrame, shingle: int, radius: int, hot_rows: int) -> DataFrame:
    """(id, fp, component_id, and the other columns kept) for rows (id, text, ...) whose fingerprints are ``fp``."""
    marks = cut_lineage(rows)
    classes = cut_lineage(marks.groupBy("fp").agg(F.min("id").cast("long").alias("node")))
    merged = components(near_links(classes.where("node IS NOT NULL"), radius, hot_rows))
    moved = classes.join(merged, "node").where("node != component").select("fp", "component")
    # a table of its own, so that a frequent fingerprint's rows can be split where they meet it
    named = cut_lineage(classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return marks.join(named, "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reachable over links."""
    found = _marked(fingerprints(docs, id_col, text_col, shingle), shingle, radius, hot_rows)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, and of several with that the one whose hash is smallest.

    Here the fingerprint classes are the nodes, so that rows that share an id
    alone are not linked by it. A class without any id adds no link and keeps
    one row.
    """
    key = F.xxhash64("doc_id", "text")
    prints = fingerprints(docs.withColumn("own key", F.struct(F.col("doc_id"), key.alias("key"))), "own key", "text", shingle)
    marks = cut_lineage(prints.select(F.col("id.doc_id").alias("id"), "fp", F.col("id.key").alias("key")))
    classes = cut_lineage(marks.groupBy("fp").agg(F.count("id").alias("ids")))
    merged = components(near_links(classes.where("ids > 0").select("fp", F.col("fp").alias("node")), radius, hot_rows))
    merged = merged.select(F.col("node").alias("fp"), "component")
    # a table of its own, so that a frequent fingerprint's rows can be split where they meet it
    named = cut_lineage(classes.join(merged, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))
    # numbers only, so that both are hash aggregates
    least = marks.join(named, "fp").groupBy("component", "id").agg(F.min("key").alias("key"))
    stay = least.groupBy("component").agg(F.coalesce(F.min_by("key", "id"), F.min("key")).alias("own key")).select("own key")
    rows = docs.withColumn("own key", key).join(stay, "own key", "left_semi")
    return rows.withColumn("own rank", F.row_number().over(Window.partitionBy("own key").orderBy("own key"))).where("`own rank` = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
