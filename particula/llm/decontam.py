"""Benchmark decontamination by spaced-seed hashing.

Method. Words (A-Z lowered, runs of digits, letters and non-ASCII characters)
are hashed; a spaced seed is a fixed mask over ``SPAN`` words in a row of which
only the marked ones enter the window's hash, so a substituted word at an
ignored position does not hide the window. The benchmark's window hashes are a
sorted array in a broadcast; every window of every document is looked up in it.
The masks are so short that one of them fits in every stretch that qualifies, so
no overlap is missed (tests go through all patterns of substitutions).
A hit fixes document, item and offset; there the whole item is laid beside the
document, and it is an overlap if any stretch reaches ``min_words`` words (or
the item's length, if that is less) and a share of equal words of
``similarity``. Reported is the stretch with most matches, each substitution
costing as much as four matches bring, or the longest, if that one is too short.

The benchmark is cut into blocks of at most ``block_bytes`` of text, so that a
broadcast has a bound whatever the benchmark's size; the documents are read
once for each block. Items shorter than ``min_words`` are searched whole: their
masks keep two of s + 2 parts, where s words may differ, and below 5 words at a
share of 0.8 none may. Items of fewer than ``min_item`` words are left out; the
queries and the pipeline leave out none. A character of a script without spaces
(Chinese, Japanese, Thai) is a word.

Defined cases: null or empty texts and items match nothing; repeated documents
and repeated items are reported each; empty tables give no rows; other columns
are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K

# The seeds; 1 marks a word that counts. Every stretch of 12 words
# or more with 0.8 of them equal has a place where one of the two fits.
SEEDS = ("111011", "11111")
SPAN = 12
#: Smallest item in words that is searched, if the caller names no other.
MIN_ITEM = 5
MIN_WORDS = 12
SIMILARITY = 0.8
#: A block of the benchmark: its texts, hashes and places take about 30 times this in a task.
BLOCK_BYTES = 2 << 20
#: Hits, or words laid beside each other, that a task holds at once.
AT_ONCE = 1 << 20
_PLACE_KEYS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * K.U64(2) + K.U64(1)


#: First and last character of the scripts that put no spaces between words.
UNSPACED = (
    *((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF)),  # Thai, Lao, Tibetan, Myanmar, Khmer, Tai
    *((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)),  # Han, Japanese, Bopomofo
    *((0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)),
)


def _unspaced_edges(data: np.ndarray) -> np.ndarray:
    """Where characters of unspaced scripts begin and end."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    size = np.where(data[at] >= 0xF0, 4, 3)
    tail = [padded[at + k] & 63 for k in (1, 2, 3)]
    three = (padded[at] & 15) << 12 | tail[0] << 6 | tail[1]
    code = np.where(size == 3, three, (padded[at] & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
    bounds = np.array(sorted(UNSPACED))
    k = np.searchsorted(bounds[:, 0], code, "right") - 1
    own = (k >= 0) & (code <= bounds[k, 1])
    return np.union1d(at[own], np.minimum(at[own] + size[own], len(data)))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As in ``textkernel``, but a character of an unspaced script is a word."""
    edges = _unspaced_edges(data)
    if not len(edges):
        return K.word_hashes(data, off)
    low = K.LOWER[data]
    starts, ends, _ = K.words(low, np.union1d(off, edges))
    return K.stretch_hash(K.prefix_hash(low), starts, ends), np.searchsorted(starts, off)


def _windows(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the window at every word that has room for the mask in the whole array."""
    span = len(mask)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, span, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += hashes[j : j + n] * _PLACE_KEYS[j]
    return K.mix(out)


def _weights(similarity: float) -> tuple[int, int]:
    """Whole numbers (gain, loss) of an equal and of another word: a stretch has the share if its sum is not negative."""
    share = Fraction(str(similarity)).limit_denominator(10**6)
    return share.denominator - share.numerator, share.numerator


def masks(size: int, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> tuple[str, ...]:
    """Masks of which one fits somewhere in every overlap with an item of ``size`` words.

    A stretch of twice ``min_words`` or more has a half that qualifies, so only
    shorter ones count. Of n words with s others one run of equal words has
    (n - s) / (s + 1) or more. A shorter item has masks of its own length.
    """
    need = min(size, min_words)
    if need >= SPAN and similarity >= SIMILARITY:
        return SEEDS
    gain, loss = _weights(similarity)
    if size < min_words and size < SPAN:
        # the whole item is the only stretch: of s + 2 parts two have no other word
        others = size * gain // (gain + loss)
        parts = np.array_split(np.arange(size), min(others + 2, size))
        picks = combinations(parts, len(parts) - others)
        return tuple("".join("01"[k in kept] for k in range(size)) for kept in (set(np.concatenate(p).tolist()) for p in picks))
    lengths = np.arange(need, min(2 * need - 1, size) + 1)
    others = lengths * gain // (gain + loss)
    run = int((-(-(lengths - others) // (others + 1))).min())
    return ("1" * min(max(run, 1), SPAN),)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The different rows, sorted by their columns from the first on."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows


class Index:
    """A block of the benchmark: items' words and the sorted hashes of their windows."""

    def __init__(self, ids: list, texts: list[str], min_words: int = MIN_WORDS, similarity: float = SIMILARITY, min_item: int = MIN_ITEM):
        self.ids, self.min_words, self.similarity = ids, min_words, similarity
        hashes, first = [], [0]
        for _, _, data, off in K.pieces(pa.array(texts, pa.string())):
            h, f = word_hashes(data, off)
            hashes.append(h)
            first.extend((f[1:] + first[-1]).tolist())
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.array(first)
        self.size = np.diff(self.first)
        users: dict[str, list[int]] = {}
        of_size = {n: masks(n, min_words, similarity) if n >= max(1, min_item) else () for n in set(self.size.tolist())}
        for item, n in enumerate(self.size.tolist()):
            for mask in of_size[n]:
                users.setdefault(mask, []).append(item)
        self.tables = []
        for mask, items in users.items():
            at = np.concatenate([np.arange(self.first[i], self.first[i + 1] - len(mask) + 1) for i in items])
            h = _windows(self.hashes, mask)[at]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            item = np.searchsorted(self.first, at, "right") - 1
            # a bit for every prefix that occurs, 64 or more to a window: most windows end here
            shift = K.U64(64 - min(22, len(h).bit_length() + 6))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[(h >> shift).astype(np.int64)] = True
            self.tables.append((mask, h, item, at - self.first[item], shift, seen))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item, offset of the item's first word in the document) that hold an overlap, one a row."""
        doc_of = K.owner(first)
        found = [np.zeros((0, 3), np.int64)]
        for mask, h, item, place, shift, seen in self.tables:
            w = _windows(hashes, mask)
            if not len(w) or not len(h):
                continue
            at = np.flatnonzero(seen[(w >> shift).astype(np.int64)])
            at = at[doc_of[at] == doc_of[at + len(mask) - 1]]
            low = np.searchsorted(h, w[at], "left")
            n = np.searchsorted(h, w[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            # every place of the benchmark with this hash, a bounded number at once
            upto = np.cumsum(n)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] - n[i] + AT_ONCE, "right")))
                m = n[i:j]
                entry = np.repeat(low[i:j] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                word = np.repeat(at[i:j], m)
                doc = doc_of[word]
                rows = _distinct(np.stack([doc, item[entry], word - first[doc] - place[entry]], axis=1))
                found.append(rows[self.qualify(hashes, first, rows)])
                i = j
        return _distinct(np.concatenate(found))

    def qualify(self, hashes: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For every (document, item, offset), whether any stretch there is an overlap."""
        gain, loss = _weights(self.similarity)
        doc, item, offset = rows.T
        size = self.size[item]
        a = np.maximum(0, -offset)
        n = np.minimum(size, first[doc + 1] - first[doc] - offset) - a
        need = np.maximum(1, np.minimum(self.min_words, size))
        mine, other = self.first[item] + a, first[doc] + offset + a
        out = np.zeros(len(rows), bool)
        live = np.flatnonzero(n >= need)
        live = live[np.lexsort((n[live], need[live]))]
        i = 0
        while i < len(live):
            j = min(len(live), i + max(1, AT_ONCE // int(n[live[i]])))
            j = i + int(np.searchsorted(need[live[i:j]], need[live[i]], "right"))
            while j - i > 1 and (j - i) * n[live[j - 1]] > AT_ONCE:
                j = i + (j - i) // 2
            part, k = live[i:j], int(need[live[i]])
            i = j
            col = np.arange(n[part[-1]])
            same = self.hashes[np.minimum(mine[part, None] + col, len(self.hashes) - 1)] == hashes[np.minimum(other[part, None] + col, len(hashes) - 1)]
            same &= col < n[part, None]
            enough = same.sum(axis=1) * (gain + loss) >= k * loss
            part, same = part[enough], same[enough]
            total = np.zeros((len(part), len(col) + 1), np.int64)
            np.cumsum(np.where(same, gain, -loss), axis=1, out=total[:, 1:])
            low = np.minimum.accumulate(total, axis=1)[:, : len(col) + 1 - k]
            out[part] = ((total[:, k:] >= low) & (np.arange(k, len(col) + 1) <= n[part, None])).any(axis=1)
        return out

    def verify(self, words: np.ndarray, item: int, offset: int, min_words: int, similarity: float):
        """(start in the document, start in the item, words, equal words) of a stretch that qualifies, or None.

        It is the one that scores best, if that qualifies, or else the longest that does.
        """
        mine = self.hashes[self.first[item] : self.first[item + 1]]
        a, b = max(0, -offset), min(len(mine), len(words) - offset)
        same = mine[a:b] == words[a + offset : b + offset]
        gain, loss = _weights(similarity)
        total = np.concatenate([[0], np.cumsum(np.where(same, gain, -loss))])
        need = max(1, min(min_words, len(mine)))
        low = np.minimum.accumulate(total)
        best = (total - low)[::-1]
        end = len(total) - 1 - int(np.argmax(best))
        start = int(np.flatnonzero(total[: end + 1] == low[end])[0])
        if end - start < need:
            # the furthest end that is no lower than each start: the stretch has the share if its sum is not negative
            high = np.maximum.accumulate(total[::-1])[::-1]
            reach = np.searchsorted(-high, -total, "right") - 1
            start = int(np.argmax(reach - np.arange(len(total))))
            end = int(reach[start])
            if end - start < need:
                return None
        return a + offset + start, a + start, end - start, int(same[start:end].sum())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Blocks of the benchmark, each of about block_bytes; an item is never cut."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        got = part.orderBy("id", "text").collect()
        yield [r["id"] for r in got], [r["text"] for r in got]


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
    min_item: int = MIN_ITEM,
) -> DataFrame:
    """One row per verified overlap: id, item id, doc_word, item_word, n_words, n_equal, similarity. ``docs``' id may be a struct."""
    spark = docs.sparkSession
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField(item_col, T.StringType()),
        *(T.StructField(c, T.LongType()) for c in ("doc_word", "item_word", "n_words", "n_equal")),
        T.StructField("similarity", T.DoubleType()),
    ]
    schema = T.StructType(fields)
    source = K.short_batches(docs).select(id_col, text_col)

    def search(sent):
        def run(batches):
            index = Index(*sent.value, min_words, similarity, min_item)
            for batch in batches:
                rows, items, out = [], [], []
                for a, _, data, off in K.pieces(batch.column(1)):
                    hashes, first = word_hashes(data, off)
                    for d, item, offset in index.hits(hashes, first).tolist():
                        if got := index.verify(hashes[first[d] : first[d + 1]], item, offset, min_words, similarity):
                            rows.append(a + d)
                            items.append(index.ids[item])
                            out.append(got)
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                found = [pa.array(c, pa.int64()) for c in cols]
                share = pa.array([e / n for n, e in zip(cols[2], cols[3], strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.string()), *found, share], names=schema.names)

        return run

    parts = [source.mapInArrow(K.tidy(search(spark.sparkContext.broadcast(block))), schema) for block in _blocks(benchmark, item_col, "text", block_bytes)]
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return out.withColumn(item_col, F.col(item_col).cast(benchmark.schema[item_col].dataType))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without a verified overlap, with all their columns.

    Rows are marked in the pass over the texts, one block after another, so that repeated and null ids need no join.
    """
    spark = K.short_batches(docs).sparkSession
    min_words, similarity = how.get("min_words", MIN_WORDS), how.get("similarity", SIMILARITY)
    min_item = how.get("min_item", MIN_ITEM)

    def keep(sent):
        def run(batches):
            index = Index(*sent.value, min_words, similarity, min_item)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for a, _, data, off in K.pieces(batch.column("text")):
                    hashes, first = word_hashes(data, off)
                    good[a + index.hits(hashes, first)[:, 0]] = False
                yield batch.filter(pa.array(good))

        return run

    for block in _blocks(benchmark, "item_id", "text", how.get("block_bytes", BLOCK_BYTES)):
        docs = docs.mapInArrow(K.tidy(keep(spark.sparkContext.broadcast(block))), docs.schema)
    return docs
