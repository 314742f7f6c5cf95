"""Token-id output: best-fit-decreasing packing with a segment-tree search for capacity.

Method. Documents are dealt and grouped as in ``ffd_pack``. A document longer
than a row of the matrix is split without loss: full rows, and a rest. Pieces
go, longest first, into the bin with the least free space that still suffices;
a segment tree over the possible free spaces holds the number of bins with each,
and one descent finds the smallest space that suffices. Each finished bin is a
row of the id matrix: ``length`` unsigned 32-bit little-endian ids, padded with
``pad_id`` at the end; with its cumulative segment lengths (from 0 to the used
length), the places where positions start again, and the segments' documents.

Defined cases: a null text is empty and consists of the end id alone; repeated
rows are packed one by one; an empty table gives no rows; other columns are
ignored; documents of any length are split without loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .ffd_pack import GROUP_TOKENS, LENGTH, Piece, cut_long, dealt, groups
from .tokens import Encoder


class Spaces:
    """Segment tree over free spaces 0..length: how many open bins have one in each range."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def _add(self, space: int, by: int) -> None:
        i = space + self.leaves
        while i:
            self.count[i] += by
            i //= 2

    def put(self, space: int, at: int) -> None:
        self.bins.setdefault(space, []).append(at)
        self._add(space, 1)

    def best(self, size: int) -> tuple[int, int] | None:
        """(free space, bin) with the least space of at least ``size``, taken out of the tree; None if there is none."""
        i = size + self.leaves
        while not self.count[i]:
            while i & 1:  # a right child: its parent's range ends here
                i //= 2
                if not i:
                    return None
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        space = i - self.leaves
        self._add(space, -1)
        return space, self.bins[space].pop()


def best_fit(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """Bins of pieces, longest first; ties in the order of documents."""
    spaces, bins = Spaces(length), []
    for p in sorted(pieces, key=lambda p: (-p.size, p.doc, p.start)):
        space, at = spaces.best(p.size) or (length, len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(p)
        if space > p.size:
            spaces.put(space - p.size, at)
    return bins


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    pad_id: int = 0,
    length: int = LENGTH,
    group_tokens: int = GROUP_TOKENS,
    partitions: int | None = None,
) -> DataFrame:
    """One row per row of the matrix: sequence_id, ids (binary), used, cu_seqlens, resets, doc_ids, doc_starts."""
    key = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("used", T.IntegerType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("resets", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(key)),
            T.StructField("doc_starts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        encoder, sequence = Encoder(tokenizer, end_id), TaskContext.get().partitionId() << 40
        held = {}

        def typed(batches):
            for batch in batches:
                held["type"] = batch.column(0).type
                yield batch

        for keys, found in groups(typed(batches), encoder, group_tokens):
            full, rest = cut_long([len(x) for x in found], length)
            out = full + best_fit(rest, length)
            for a in range(0, len(out), 512):
                rows, cuts, resets, ids, starts = [], [], [], [], []
                for packed in out[a : a + 512]:
                    row = np.full(length, pad_id, "<u4")
                    ends = np.cumsum([0, *(p.size for p in packed)]).tolist()
                    for p, at in zip(packed, ends, strict=False):
                        row[at : at + p.size] = found[p.doc][p.start : p.start + p.size]
                    rows.append(row.tobytes())
                    cuts.append(ends)
                    resets.append(ends[:-1])
                    ids.append([keys[p.doc] for p in packed])
                    starts.append([p.start for p in packed])
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(sequence, sequence + n), pa.int64()),
                        pa.array(rows, pa.binary()),
                        pa.array([c[-1] for c in cuts], pa.int32()),
                        pa.array(cuts, pa.list_(pa.int32())),
                        pa.array(resets, pa.list_(pa.int32())),
                        pa.array(ids, pa.list_(held["type"])),
                        pa.array(starts, pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )
                sequence += n

    return dealt(docs, id_col, text_col, partitions).mapInArrow(run, schema)


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position of every id of a row, starting again with each segment; the padding goes on from zero."""
    edges = np.array([*cu_seqlens, length]) if cu_seqlens[-1] < length else np.array(cu_seqlens)
    return np.concatenate([np.arange(b - a, dtype=np.int32) for a, b in zip(edges, edges[1:], strict=False)])


def write(packed: DataFrame, path: str) -> None:
    """The matrix rows as Parquet files in the order of sequences; a row's ids are one binary value of 4 * length bytes."""
    packed.write.mode("errorifexists").parquet(path)
