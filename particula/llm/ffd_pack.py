"""Sequence packing by first-fit decreasing over a tournament tree of bin capacities.

Method. Documents are dealt at random (by a hash) over partitions and read
there in hash order; every run of about ``GROUP_TOKENS`` tokens is a group that
is packed on its own, so a task holds one group at a time however many rows
its partition has. A document longer than a sequence gives full sequences; its
rest, and every shorter document, is a piece. Pieces go, longest first, into
the first bin with room: the tournament tree keeps the largest free space of
each half, and the descent takes the left half whenever it has enough.

A sequence is padded to ``length`` unless it holds a power of two of tokens.
So what first fit leaves open is closed by cutting: the emptiest bins are cut
up to fill the fullest, and the one bin left over is cut at the binary digits
of its size. No padding remains, and few documents are cut for it.

Defined cases: a null text is empty and consists of the end id alone; rows that
repeat (ids too) are packed one by one; an empty table gives no rows; other
columns are ignored; a document of any length is cut without loss. The numbers
of sequences depend on the number of partitions only, not on the order in which
rows arrive.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .textkernel import short_batches, tidy
from .tokens import Encoder

LENGTH = 2048
GROUP_TOKENS = 1 << 21


@dataclass(frozen=True)
class Piece:
    """Ids [start, start + size) of the group's document ``doc``."""

    doc: int
    start: int
    size: int


class FreeSpace:
    """Tournament tree: the free space of every bin, and above it the larger of each two."""

    def __init__(self, bins: int, length: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.top = [length] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, after taking it. There must be one."""
        i = 1
        while i < self.leaves:
            i *= 2
            if self.top[i] < size:
                i += 1
        found = i - self.leaves
        self.top[i] -= size
        while i > 1:
            i //= 2
            self.top[i] = max(self.top[2 * i], self.top[2 * i + 1])
        return found


def cut_long(sizes: list[int], length: int) -> tuple[list[list[Piece]], list[Piece]]:
    """(full sequences of documents that are longer, the pieces that are left)."""
    full, rest = [], []
    for doc, n in enumerate(sizes):
        whole = n // length * length
        full += [[Piece(doc, s, length)] for s in range(0, whole, length)]
        if n > whole:
            rest.append(Piece(doc, whole, n - whole))
    return full, rest


def first_fit(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """Bins of pieces, longest first; ties in the order of documents."""
    free, bins = FreeSpace(len(pieces), length), []
    for p in sorted(pieces, key=lambda p: (-p.size, p.doc, p.start)):
        at = free.take(p.size)
        if at == len(bins):
            bins.append([])
        bins[at].append(p)
    return bins


def close(bins: list[list[Piece]], length: int) -> list[list[Piece]]:
    """The same ids in bins that need no padding: full ones, and at the end powers of two."""
    used = [sum(p.size for p in b) for b in bins]
    shut = [b for b, u in zip(bins, used, strict=True) if u == length]
    open_bins = sorted(((u, b) for u, b in zip(used, bins, strict=True) if u < length), key=lambda x: -x[0])
    first, last = 0, len(open_bins) - 1
    open_bins = [[u, list(b)] for u, b in open_bins]
    while first < last:
        taker, giver = open_bins[first], open_bins[last]
        gap = length - taker[0]
        p = giver[1].pop()
        if p.size > gap:
            giver[1].append(Piece(p.doc, p.start, p.size - gap))
            p = Piece(p.doc, p.start + p.size - gap, gap)
        taker[1].append(p)
        taker[0] += p.size
        giver[0] -= p.size
        if taker[0] == length:
            shut.append(taker[1])
            first += 1
        if not giver[0]:
            last -= 1
    if first == last:
        left, rest = open_bins[first]
        for bit in range(left.bit_length() - 1, -1, -1):
            room, part = left & (1 << bit), []
            while room:
                p = rest.pop(0)
                if p.size > room:
                    rest.insert(0, Piece(p.doc, p.start + room, p.size - room))
                    p = Piece(p.doc, p.start, room)
                part.append(p)
                room -= p.size
            if part:
                shut.append(part)
    return shut


def pack_group(sizes: list[int], length: int = LENGTH) -> list[list[Piece]]:
    full, rest = cut_long(sizes, length)
    return full + close(first_fit(rest, length), length)


def dealt(docs: DataFrame, id_col: str, text_col: str, partitions: int | None) -> DataFrame:
    """(id, text) dealt at random by a hash of both and sorted by it, so that groups do not depend on the order of arrival."""
    rows = short_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("o", F.xxhash64("id", "text"))
    rows = rows.repartition(partitions, "o") if partitions else rows.repartition("o")
    return rows.sortWithinPartitions("o", "id").select("id", "text")


def groups(batches, encoder: Encoder, group_tokens: int):
    """Runs of documents: (ids of the documents as Arrow array, their token ids)."""
    keys, found, n = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            got = encoder(text.as_py())
            keys.append(key.as_py())
            found.append(got)
            n += len(got)
            if n >= group_tokens:
                yield keys, found
                keys, found, n = [], [], 0
    if keys:
        yield keys, found


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, partitions: int | None = None
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names[1:])])
    key_type = None

    def run(batches):
        encoder, sequence = Encoder(tokenizer, end_id), TaskContext.get().partitionId() << 40

        def typed(batches):
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield batch

        for keys, found in groups(typed(batches), encoder, group_tokens):
            rows = []
            for packed in pack_group([len(x) for x in found], length):
                offset = 0
                for p in packed:
                    ids = found[p.doc][p.start : p.start + p.size].astype("<u4").tobytes()
                    rows.append((p.doc, p.start, p.size, zlib.crc32(ids), len(found[p.doc]), sequence, offset))
                    offset += p.size
                sequence += 1
            cols = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in cols[0]], key_type), *(pa.array(c) for c in cols[1:])], names=names)

    return dealt(docs, id_col, text_col, partitions).mapInArrow(tidy(run), schema)
