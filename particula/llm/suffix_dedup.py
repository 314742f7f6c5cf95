"""Suffix-array dedup: removes the bytes that repeat an earlier document for ``span`` bytes or more.

A byte goes if a ``span``-byte string covers it that also starts in a document
with a smaller id. Strings are those of the input, and never cross documents.

Method. Any two equal strings of ``span`` bytes hold the same smallest
``GRAM``-byte hash at the same place (an anchor), so only stretches around
anchors that two documents share can match. A stretch is an anchor with all the
bytes that strings over it can reach.

1. ``_ask``: every piece of documents sends its anchors' hashes, dealt by hash.
   What several documents of a piece share is known there and then.
2. ``_answer``: a range of hashes learns which of them two pieces share, and
   answers the documents that asked.
3. ``_offer``: documents meet their shared hashes, and send each shared anchor
   with a digest of its stretch. Of equal stretches of a piece only the smallest
   id is sent, the others are decided. Anchors that more than ``hot`` rows hold
   are sent as single strings under their own hash, so no group grows with them.
   ``_gather``: an anchor's rows meet. Equal stretches are one; all its rows but
   that of the smallest id lose it. Where an anchor has several stretches their
   texts are asked for, one text for each.
4. ``_send``, ``_sort``: the different stretches of an anchor meet. What they
   all have around the anchor becomes one symbol of their own; those of many
   anchors together get one suffix array by linear grouping (``suffix_sort``).
   Neighbours in it that agree as far as a string reaches form runs, and each
   run's smallest id decides for that string.
5. ``_cut``: a document's stretches are joined and cut out.

A task of steps 1, 3, 4 (sending) and 5 holds an Arrow batch of documents, one
of the others a hash range of about ``RANGE_BYTES`` of text, or one batch of
stretches. The texts are shuffled once and met three times.

Defined cases: null and empty texts have nothing to remove; a row without an id
is kept whole and removes nothing; rows with the same id do not remove each
other's bytes (repeats within a document stay); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from particula.session import scratch_path

from . import textkernel as K
from .suffix_sort import suffix_array

SPAN = 50
#: Bytes of an anchor.
GRAM = 20
#: Text whose anchors one range of hashes takes, and how many ranges there are at least.
RANGE_BYTES = 32 << 20
LEAST_RANGES = 16
#: Text whose repeated anchors and stretches are found together in steps 1 and 3.
PIECE_BYTES = 1 << 20
#: Rows that hold an anchor before it is sent string by string.
HOT = 20_000
#: Bytes of such anchors' names that are broadcast at most; beyond, the least frequent are grouped like others.
HOT_BYTES = 32 << 20
#: Bytes that get one suffix array together, at least; a group of stretches is never cut.
SORT_BYTES = 1 << 16
_SALT = 1 << 20
#: A name is a hash range and 40 bits of the hash; the bits are sent as 5 bytes. With ranges of a fixed size, names that
#: meet by chance are as rare at any size of the input, and they cost a comparison only.
_LOW = K.U64((1 << 40) - 1)
_ROW = K.U64(0xD1342543DE82EF95)


def _names(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> K.U64(40)) % K.U64(ranges) << K.U64(40)) | (hashes & _LOW)


def _pack(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the piece, hash) of the smallest grams of all strings of ``span`` bytes, by place."""
    n = len(data)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = K.prefix_hash(data)
    _, down = K.powers(n + 1)
    # never zero, which marks strings that cross documents below
    hashes = K.mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1]) | K.U64(1)
    width = span - gram + 1
    least = _slide(hashes, width, np.minimum)
    # strings that start less than span bytes before a document's end cross it
    ends = off[1:-1]
    mark = np.zeros(len(least) + 1, np.int64)
    np.add.at(mark, np.clip(ends - span + 1, 0, len(least)), 1)
    np.add.at(mark, np.clip(ends, 0, len(least)), -1)
    least[np.cumsum(mark[:-1]) > 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    place = np.flatnonzero(most == hashes)
    return np.searchsorted(off, place, "right") - 1, place, hashes[place]


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _by_range(row: np.ndarray | None, names: np.ndarray):
    """(range, its entries in the order of rows)."""
    part = (names >> K.U64(40)).astype(np.int64)
    order = np.argsort(part, kind="stable") if row is None else np.lexsort((row, part))
    cut = _runs(part[order])
    for i, j in zip(cut, cut[1:], strict=False):
        yield int(part[order[i]]), order[i:j]


_ASKED = [("route", pa.int64()), ("kind", pa.int8()), ("part", pa.int64()), ("rows", pa.binary()), ("n", pa.binary()), ("names", pa.binary())]


def _ask(span: int, gram: int, ranges: int):
    """kind 0: names of one row of the piece, to be answered; 1: names that the piece knows to be shared, and by how many rows; 2: such names with their rows, to pass on."""

    def run(batches):
        for batch in batches:
            keys, out = batch.column("key").to_numpy(), []

            def tell(kind, route, row, names, own, out=out):
                for q, pick in _by_range(row, names):
                    r, n = np.unique(row[pick], return_counts=True)
                    out.append((q if route is None else route, kind, q, own[r].tobytes(), n.astype(np.uint32).tobytes(), _pack(names[pick])))

            for a, b, data, off in K.pieces(batch.column("text"), PIECE_BYTES):
                row, _, h = anchors(data, off, span, gram)
                if not len(h):
                    continue
                names, own = _names(h, ranges), keys[a:b]
                order = np.argsort(names, kind="stable")  # rows are in order already
                row, names = row[order], names[order]
                first = np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])])
                row, names = row[first], names[first]
                cut = _runs(names)
                n = np.diff(cut)
                shared = np.repeat(n > 1, n)
                tell(0, None, row[~shared], names[~shared], own)
                told, times = names[cut[:-1][n > 1]], n[n > 1].astype(np.uint32)
                for q, pick in _by_range(None, told):
                    out.append((q, 1, q, b"", times[pick].tobytes(), _pack(told[pick])))
                tell(2, ranges + int(h[0] & K.U64(_SALT - 1)), row[shared], names[shared], own)
            yield _batch(_ASKED, out)

    return run, "route long, kind byte, part long, rows binary, n binary, names binary"


def _by_route(batches, work):
    """Calls ``work`` with the rows of one route after another."""
    route, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for r, *row in zip(*cols, strict=True):
            if r != route and held:
                yield work(held)
                held = []
            route = r
            held.append(row)
    if held:
        yield work(held)


def _answer(hot: int):
    """To (key, part, level, its shared names). A row without a key lists names that from ``hot * 2**level`` to twice as many rows hold."""
    schema = [("key", pa.int64()), ("part", pa.int64()), ("level", pa.int32()), ("names", pa.binary())]

    def answer(rows: list[list]) -> pa.RecordBatch:
        out, keys, names, told, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for kind, part, r, n, v in rows:
            r, n = np.frombuffer(r, np.int64), np.frombuffer(n, np.uint32)
            if kind == 0:
                keys.append(np.repeat(r, n))
                names.append(_unpack(v))
            elif kind == 1:
                told.append(_unpack(v))
                times.append(n)
            else:
                at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) * 5
                out += [(k, part, None, v[i:j]) for k, i, j in zip(r.tolist(), at, at[1:], strict=False)]
        part = rows[0][1]
        keys, names, told, times = map(np.concatenate, (keys, names, told, times))
        found, place = np.unique(np.concatenate([names, told]), return_inverse=True)
        n = np.bincount(place, np.concatenate([np.ones(len(names)), times]), len(found)).astype(np.int64)
        shared = (n > 1)[place[: len(names)]]
        keys, names = keys[shared], names[shared]
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.concatenate([np.ones(min(len(keys), 1), bool), (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])
        keys, packed = keys[new], _pack(names[new])  # equal rows ask alike
        cut = _runs(keys)
        out += [(int(keys[i]), part, None, packed[5 * i : 5 * j]) for i, j in zip(cut, cut[1:], strict=False)]
        found, n = found[n > hot], n[n > hot]
        level = np.log2(n / hot).astype(np.int64)
        out += [(None, part, x, _pack(found[level == x])) for x in np.unique(level).tolist()]
        return _batch(schema, out)

    return lambda batches: _by_route(batches, answer), "key long, part long, level int, names binary"


def _full(parts) -> np.ndarray:
    """Names of a list of (part, names)."""
    return np.concatenate([np.zeros(0, np.uint64), *(_unpack(p["names"]) | K.U64(p["part"] << 40) for p in parts)])


class Lists:
    """A column of lists of structs: row r has the structs cut[r]:cut[r + 1] of all of them; binary fields as one buffer each."""

    def __init__(self, col: pa.Array, numbers: tuple[str, ...], blobs: tuple[str, ...]):
        size = pc.list_value_length(col).fill_null(0).to_numpy()
        self.cut = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = col.flatten()
        self.number = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in numbers}
        self.blob = {c: K.text_buffer(flat.field(c)) for c in blobs}

    def joined(self, field: str, first: int, end: int, kind) -> np.ndarray:
        """A binary field of some structs in a row, as numbers."""
        data, off = self.blob[field]
        return np.frombuffer(data[off[first] : off[end]].tobytes(), kind)


_OFFERED = [("route", pa.int64()), ("kind", pa.int8()), ("part", pa.int64()), *((c, pa.binary()) for c in ("rows", "ids", "n", "names", "digests", "starts", "sizes"))]


def _offer(span: int, gram: int, ranges: int, hot):
    """Rows (key, id, text, wanted) to entries, for each range: kind 0 to be gathered, 1 decided already."""
    side = span - gram

    def run(batches):
        busy_names = _full(hot.value)
        for batch in batches:
            out = []
            keys, ids = batch.column("key").to_numpy(), batch.column("id").fill_null(0).to_numpy()
            wanted = Lists(batch.column("wanted"), ("part",), ("names",))
            data, off = wanted.blob["names"]
            each = np.diff(off) // 5
            want = _unpack(data.tobytes()) | np.repeat(wanted.number["part"].astype(np.uint64) << K.U64(40), each)
            # a name and its row as one number; what is taken for wanted by chance has no partner later
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.cut))
            want = K.mix(want ^ (np.repeat(of_row, each).astype(np.uint64) * _ROW))
            for a, b, data, off in K.pieces(batch.column("text"), PIECE_BYTES):
                row, place, h = anchors(data, off, span, gram)
                names = _names(h, ranges)
                pick = np.isin(K.mix(names ^ ((row + a).astype(np.uint64) * _ROW)), want)
                if not pick.any():
                    continue
                row, place, names = row[pick], place[pick], names[pick]
                low, high = np.maximum(off[row], place - side), np.minimum(off[row + 1], place + span)
                left = place - low
                prefix = K.prefix_hash(data)
                busy = np.isin(names, busy_names)
                if busy.any():
                    n = (high - low)[busy] - span + 1
                    s = np.repeat(low[busy] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    more = np.repeat(row[busy], n)
                    row, low, high = np.concatenate([row[~busy], more]), np.concatenate([low[~busy], s]), np.concatenate([high[~busy], s + span])
                    left = np.concatenate([left[~busy], np.zeros(len(s), np.int64)])
                    names = np.concatenate([names[~busy], _names(K.stretch_hash(prefix, s, s + span), ranges)])
                digest = K.stretch_hash(prefix, low, high)
                own_ids, own_keys = ids[a:b], keys[a:b]
                entry_ids = own_ids[row]
                order = np.lexsort((low, entry_ids, digest, names))
                row, low, high, left, names, digest, entry_ids = (x[order] for x in (row, low, high, left, names, digest, entry_ids))
                new = np.concatenate([[True], (names[1:] != names[:-1]) | (digest[1:] != digest[:-1])])
                decided = entry_ids > entry_ids[np.flatnonzero(new)][np.cumsum(new) - 1]
                starts, sizes = (low - off[row]).astype(np.int32), (high - low).astype(np.uint16)
                shapes = sizes | (left << 8).astype(np.uint16)  # with the anchor's place in the stretch
                salt = ranges + int(names[0] & K.U64(_SALT - 1))
                for kind, some in ((0, ~decided), (1, decided)):
                    at = np.flatnonzero(some)
                    for q, sel in _by_range(row[at], names[at]) if kind == 0 else [(0, np.argsort(row[at], kind="stable"))] * bool(len(at)):
                        e = at[sel]
                        r, n = np.unique(row[e], return_counts=True)
                        shown = (_pack(names[e]), digest[e].tobytes()) if kind == 0 else (b"", b"")
                        out.append((salt if kind else q, kind, q, own_keys[r].tobytes(), own_ids[r].tobytes(), n.astype(np.uint32).tobytes(), *shown, starts[e].tobytes(), (sizes if kind else shapes)[e].tobytes()))
            yield _batch(_OFFERED, out)

    return run, "route long, kind byte, part long, rows binary, ids binary, n binary, names binary, digests binary, starts binary, sizes binary"


def _gather():
    """Entries of a range to (key, id, starts, sizes of what goes; groups, places, lengths of the texts that are asked for)."""
    schema = [("key", pa.int64()), ("id", pa.int64()), *((c, pa.binary()) for c in ("starts", "sizes", "groups", "places", "lengths"))]

    def gather(rows: list[list]) -> pa.RecordBatch:
        read = {"key": np.int64, "id": np.int64, "names": np.uint64, "digest": np.uint64, "start": np.int32, "size": np.uint16}
        held = {c: [np.zeros(0, t)] for c, t in read.items()}
        out = []
        for kind, part, r, i, n, v, d, s, z in rows:
            r, i, n = np.frombuffer(r, np.int64), np.frombuffer(i, np.int64), np.frombuffer(n, np.uint32)
            if kind:
                at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                out += [(k, x, s[4 * a : 4 * b], z[2 * a : 2 * b], b"", b"", b"") for k, x, a, b in zip(r.tolist(), i.tolist(), at, at[1:], strict=False)]
                continue
            for c, x in zip(held, (np.repeat(r, n), np.repeat(i, n), _unpack(v) | K.U64(part << 40), np.frombuffer(d, np.uint64), np.frombuffer(s, np.int32), np.frombuffer(z, np.uint16)), strict=True):
                held[c].append(x)
        e = {c: np.concatenate(x) for c, x in held.items()}
        if not len(e["key"]):
            return _batch(schema, out)
        order = np.lexsort((e["start"], e["key"], e["id"], e["digest"], e["names"]))
        e = {c: x[order] for c, x in e.items()}
        # equal rows offer alike: one of them stands for all
        other = np.concatenate([[True], np.any([e[c][1:] != e[c][:-1] for c in e], axis=0)])
        e = {c: x[other] for c, x in e.items()}
        new_name = np.concatenate([[True], e["names"][1:] != e["names"][:-1]])
        new = new_name | np.concatenate([[True], e["digest"][1:] != e["digest"][:-1]])
        least = e["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
        goes = e["id"] > least
        group = np.cumsum(new_name) - 1
        several = np.bincount(group[new])[group] > 1
        order = np.argsort(e["key"], kind="stable")
        e = {c: x[order] for c, x in e.items()}
        goes, asks = goes[order], (several & ~goes)[order]
        # each key's share of what goes and of what is asked for, as cuts into two joined buffers
        cut = _runs(e["key"])
        buffers = [(e["start"][goes], 4), (e["size"][goes] & 255, 2), (e["names"][asks], 8), (e["start"][asks], 4), (e["size"][asks], 2)]
        at_goes, at_asks = (np.concatenate([[0], np.cumsum(x)])[cut] for x in (goes, asks))
        raw = [x.tobytes() for x, _ in buffers]
        keys, ids = e["key"][cut[:-1]].tolist(), e["id"][cut[:-1]].tolist()
        for k, x, g0, g1, a0, a1 in zip(keys, ids, at_goes, at_goes[1:], at_asks, at_asks[1:], strict=False):
            if g1 > g0 or a1 > a0:
                out.append((k, x, raw[0][4 * g0 : 4 * g1], raw[1][2 * g0 : 2 * g1], raw[2][8 * a0 : 8 * a1], raw[3][4 * a0 : 4 * a1], raw[4][2 * a0 : 2 * a1]))
        return _batch(schema, out)

    return lambda batches: _by_route(batches, gather), "key long, id long, starts binary, sizes binary, groups binary, places binary, lengths binary"


def _send():
    """Rows (key, id, text, told) to the texts that were asked for: (group, id, key, start, left, text)."""
    schema = [("group", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("left", pa.int32()), ("text", pa.binary())]

    def run(batches):
        for batch in batches:
            out = []
            told = Lists(batch.column("told"), ("id",), ("groups", "places", "lengths"))
            asks = np.flatnonzero(np.diff(told.blob["groups"][1]))
            of_row = np.searchsorted(told.cut, asks, "right") - 1
            keys, ids, texts = batch.column("key"), batch.column("id").to_pylist(), batch.column("text")
            last, raw = None, b""
            for r, x in zip(of_row.tolist(), asks.tolist(), strict=True):
                i = ids[r]
                if told.number["id"][x] != i:
                    continue
                if r != last:
                    last, key, raw = r, keys[r].as_py(), texts[r].as_buffer().to_pybytes()
                for g, s, n in zip(told.joined("groups", x, x + 1, np.int64).tolist(), told.joined("places", x, x + 1, np.int32).tolist(), told.joined("lengths", x, x + 1, np.uint16).tolist(), strict=True):
                    out.append((g, i, key, s, n >> 8, raw[s : s + (n & 255)]))
                if len(out) >= 20_000:
                    yield _batch(schema, out)
                    out = []
            yield _batch(schema, out)

    return run, "group long, id long, key long, start int, left int, text binary"


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every entry, ``n`` numbers each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _told_apart(data: np.ndarray, first: np.ndarray, step: int, size: np.ndarray, of: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that all of a group have, bytes after them that tell a text from every other of its group), from ``first`` on."""
    col = np.arange(side)
    texts = np.zeros((len(first), -(-side // 8) * 8), np.uint8)
    inside = col < size[:, None]
    texts[:, :side][inside] = data[(first[:, None] + step * col)[inside]]
    words = texts.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *words.T[::-1], of))
    texts, n, group = texts[order], size[order], of[order]
    differs = texts[1:] != texts[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), side)
    common = np.minimum(common, np.minimum(n[1:], n[:-1]))
    together = group[1:] == group[:-1]
    most = np.maximum(np.append(0, common * together), np.append(common * together, 0))
    least = np.minimum.reduceat(np.append(np.where(together, common, side), side), _runs(group)[:-1])
    same, far = np.empty_like(size), np.empty_like(size)
    same[order] = np.minimum(least[group], n)
    far[order] = np.minimum(most + 1, n)
    return same, far - same


def repeats(groups: list[list[tuple[bytes, int, int]]], span: int, gram: int) -> list[list[int]]:
    """Which strings of stretches a stretch of the same group with a smaller id holds too.

    A group's stretches (text, place of the anchor, id) have the same ``gram``
    bytes at their anchors. Returned for each stretch, group after group: the
    starts of the strings that go.
    """
    side = span - gram
    members = [m for g in groups for m in g]
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    data = np.frombuffer(b"".join(t for t, _, _ in members), np.uint8)
    size = np.array([len(t) for t, _, _ in members], np.int64)
    lefts, ids = (np.array(x, np.int64) for x in list(zip(*members, strict=True))[1:])
    rights = size - lefts - gram
    anchor = np.cumsum(size) - size + lefts
    core_left, far_left = _told_apart(data, anchor - 1, -1, np.minimum(lefts, side), of, side)
    core_right, far_right = _told_apart(data, anchor + gram, 1, np.minimum(rights, side), of, side)
    # symbols: 0 the end, 1 between texts, bytes from 2, the groups' own from 258
    length = far_left + far_right + 2
    start = np.cumsum(length) - length
    core = start + far_left
    joined = np.ones(int(length.sum()) + 1, np.int64)
    joined[_spread(start, far_left)] = data[_spread(anchor - core_left - far_left, far_left)].astype(np.int64) + 2
    joined[_spread(core + 1, far_right)] = data[_spread(anchor + gram + core_right, far_right)].astype(np.int64) + 2
    joined[core], joined[-1] = 258 + of, 0
    order = suffix_array(joined)
    # only suffixes that begin before or at a group's symbol begin a string
    owner = np.searchsorted(start, order, "right") - 1
    order, owner = order[order <= core[owner]], owner[order <= core[owner]]
    rank = np.empty(len(joined), np.int64)
    rank[order] = np.arange(len(order))
    reach = 2 * side + 2
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([joined, np.zeros(reach, np.int64)]).astype(np.int32), reach)
    agree = np.zeros(len(order), np.int64)  # symbols that a suffix has in common with the one before it
    for i in range(0, len(order) - 1, 1 << 15):
        j = min(i + (1 << 15), len(order) - 1)
        differs = windows[order[i:j]] != windows[order[i + 1 : j + 1]]
        agree[i + 1 : j + 1] = np.where(differs.any(axis=1), differs.argmax(axis=1), reach)
    # every string: how many bytes stand left of the anchor, its suffix, and how many symbols it is
    shown = core_left + core - start  # bytes left of the anchor that are in the sorted text
    stretch, left = np.nonzero((np.arange(side + 1) <= shown[:, None]) & (side - np.arange(side + 1) <= rights[:, None]))
    inner = left <= core_left[stretch]
    suffix = core[stretch] - np.where(inner, 0, left - core_left[stretch])
    symbols = 1 + np.where(inner, 0, left - core_left[stretch]) + np.maximum(0, side - left - core_right[stretch])
    out: list[list[int]] = [[] for _ in ids]
    by_rank = ids[owner]
    for n in np.unique(symbols):
        asked = symbols == n
        run = np.flatnonzero(agree < n)
        least = np.minimum.reduceat(by_rank, run)
        at = np.searchsorted(run, rank[suffix[asked]], "right") - 1
        own, places = stretch[asked], lefts[stretch[asked]] - left[asked]
        goes = least[at] < ids[own]
        for k, s in zip(own[goes].tolist(), places[goes].tolist(), strict=True):
            out[k].append(s)
    return out


def _sort(span: int, gram: int):
    """Texts sorted by (group, id) to (key, id, starts, sizes) of what goes."""
    schema = [("key", pa.int64()), ("id", pa.int64()), ("starts", pa.binary()), ("sizes", pa.binary())]

    def run(batches):
        group, classes = None, {}  # (text, left) to its rows of the smallest id, equal rows once
        pending: list[list[tuple]] = []  # groups of (text, left, id, rows)
        weight, out = 0, []

        def tell(row, starts, size):
            at = np.array(starts, np.int32) + row[2]
            out.append((row[0], row[1], at.astype(np.int32).tobytes(), np.full(len(at), size, np.uint16).tobytes()))

        def close():
            """The classes of a group that really share an anchor, ready to be sorted."""
            nonlocal weight
            by_anchor: dict[bytes, list] = {}
            for (text, left), rows in classes.items():
                by_anchor.setdefault(text[left : left + gram], []).append((text, left, next(iter(rows))[1], rows))
            for members in by_anchor.values():
                if len(members) > 1:
                    pending.append(members)
                    weight += sum(len(m[0]) for m in members)

        def settle():
            nonlocal weight
            found = iter(repeats([[m[:3] for m in members] for members in pending], span, gram))
            for members in pending:
                for m in members:
                    if starts := next(found):
                        for row in m[3]:
                            tell(row, starts, span)
            pending.clear()
            weight = 0

        for batch in batches:
            for g, i, key, start, left, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    close()
                    classes, group = {}, g
                    if weight >= SORT_BYTES:
                        settle()
                rows = classes.setdefault((text, left), {})
                if rows and i > next(iter(rows))[1]:
                    tell((key, i, start), [0], len(text))
                else:
                    rows[key, i, start] = None
            if len(out) >= 20_000:
                yield _batch(schema, out)
                out = []
        close()
        if pending:
            settle()
        yield _batch(schema, out)

    return run, "key long, id long, starts binary, sizes binary"


def _whole_characters(data: np.ndarray, goes: np.ndarray) -> np.ndarray:
    """Marks that take a character's other bytes with a marked one."""
    char = np.cumsum((data & 0xC0) != 0x80)
    lost = np.zeros(int(char[-1]) + 1, bool)
    lost[char[goes]] = True
    return lost[char]


def _mine(lists: list[Lists], r: int, i: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes told to row r with the id i; another id there shares the row's key by chance."""
    starts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)]
    for x in lists:
        a, b = int(x.cut[r]), int(x.cut[r + 1])
        whole = a < b and i is not None and bool((x.number["id"][a:b] == i).all())
        for first, end in [(a, b)] if whole else [(k, k + 1) for k in range(a, b) if x.number["id"][k] == i]:
            starts.append(x.joined("starts", first, end, np.int32))
            sizes.append(x.joined("sizes", first, end, np.uint16))
    return np.concatenate(starts), np.concatenate(sizes)


def _cut(characters: bool, names: list[str]):
    """Rows (id, text, told, found) to n_bytes, n_removed, n_spans and kept, beside the columns ``names``."""

    def run(batches):
        for batch in batches:
            n_bytes, removed, n_spans, kept = [], [], [], []
            lists = [Lists(batch.column(c), ("id",), ("starts", "sizes")) for c in ("told", "found")]
            for r, (i, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text"), strict=True)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                start, size = _mine(lists, r, i)
                runs = 0
                if len(start):
                    cover = np.bincount(start, minlength=len(raw) + 1)
                    cover -= np.bincount(start + size, minlength=len(raw) + 1)
                    data, goes = np.frombuffer(raw, np.uint8), np.cumsum(cover[:-1]) > 0
                    if characters:
                        goes = _whole_characters(data, goes)
                    runs = int(goes[0]) + int(np.count_nonzero(goes[1:] & ~goes[:-1]))
                    kept.append(data[~goes].tobytes())
                else:
                    kept.append(raw)
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                n_spans.append(runs)
            cols = [*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in (n_bytes, removed, n_spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _hot_names(answered: DataFrame, most: int = HOT_BYTES) -> list[dict]:
    """The names of the lowest level from which all fit into ``most`` bytes; those left out have fewer rows in each group."""
    sizes = answered.where("level IS NOT NULL").groupBy("level").agg(F.sum(F.octet_length("names")).alias("n")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in sizes:
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return []
    return [{"part": r["part"], "names": bytes(r["names"])} for r in answered.where(F.col("level") >= least).select("part", "names").collect()]


def met(rows: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``rows`` (key, id, text, ...) with the stretches that go: told and found, arrays of (id, starts, sizes, ...), overlapping.

    The three joins deal the same rows by the same key, so that their shuffle is written once. Rows equal in id and
    text share a key, and what is found for one of them is kept once and joined to all: work grows with their number.
    """
    spark = K.short_batches(rows).sparkSession
    if not gram < span <= 128:
        raise ValueError("a string holds an anchor, and a stretch has a length of one byte")
    known = rows.where("id IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-total // RANGE_BYTES))
    ask, ask_schema = _ask(span, gram, ranges)
    answer, answer_schema = _answer(hot)
    asked = known.select("key", "text").mapInArrow(K.tidy(ask), ask_schema)
    # a table of its own: the frequent names must be known before documents meet their answers
    path = scratch_path(spark, f"answers-{uuid.uuid4().hex}")
    asked.repartition(F.col("route")).sortWithinPartitions("route").mapInArrow(K.tidy(answer), answer_schema).write.parquet(path)
    answered = spark.read.parquet(path)
    offer, offer_schema = _offer(span, gram, ranges, spark.sparkContext.broadcast(_hot_names(answered)))
    gather, gather_schema = _gather()
    send, send_schema = _send()
    sort, sort_schema = _sort(span, gram)
    wanted = answered.where("key IS NOT NULL").groupBy("key").agg(F.collect_set(F.struct("part", "names")).alias("wanted"))
    offered = rows.join(wanted, "key", "left").mapInArrow(K.tidy(offer), offer_schema)
    gathered = offered.repartition(F.col("route")).sortWithinPartitions("route").mapInArrow(K.tidy(gather), gather_schema)
    told = gathered.groupBy("key").agg(F.collect_set(F.struct("id", "starts", "sizes", "groups", "places", "lengths")).alias("told"))
    with_told = rows.join(told, "key", "left")
    sent = with_told.mapInArrow(K.tidy(send), send_schema)
    found = sent.repartition(F.col("group")).sortWithinPartitions("group", "id").mapInArrow(K.tidy(sort), sort_schema)
    found = found.groupBy("key").agg(F.collect_set(F.struct("id", "starts", "sizes")).alias("found"))
    return with_told.join(found, "key", "left")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    done = met(rows, span, gram, hot).mapInArrow(K.tidy(_cut(False, ["id"])), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents, all of them and with all columns, without the repeated bytes.

    A character that loses a byte goes whole, so that texts stay valid. Where a
    text was cut, ``n_chars`` (if there is such a column) is its new length.
    """
    fields = docs.columns
    rest = F.struct(F.col("text").isNotNull().alias("own text"), *[F.col(f"`{c}`") for c in fields if c != "text"])
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("id"), "text", rest.alias("rest"))
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), *counts, T.StructField("kept", T.BinaryType())])
    done = met(rows, span).mapInArrow(K.tidy(_cut(True, ["rest"])), schema)
    text = F.when(F.col("rest.own text"), F.col("kept").cast("string"))

    def column(c):
        if c == "text":
            return text.alias("text")
        own = F.col(f"rest.`{c}`")
        return (F.when(F.col("n_removed") > 0, F.length(text)).otherwise(own).cast(docs.schema[c].dataType) if c == "n_chars" else own).alias(c)

    return done.select(*[column(c) for c in fields])
