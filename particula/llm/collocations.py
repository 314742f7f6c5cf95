"""Phrase collocations by SON partitioning: mine shards completely, then count what they found exactly.

A phrase is a run of 1 to ``longest`` words inside one piece of a text; phrases
of two words or more that occur ``support`` times in a language are candidates.

Method. Pass 1 writes the texts as rows of about ``chunk_bytes``: words of a
language in their order, a blank between words and a line end between pieces.
Pass 2 reads them as units of up to ``unit_words`` words, counts every phrase of
a unit, and sends hash and count to one of many hash slices, packed as sorted
differences of as few bits as the corpus needs. Units belong to ``SHARDS``
shards. A slice holds all its phrases of every shard, so the slices together mine each
shard completely at the local support ceil(support / SHARDS). A phrase below that in
every shard has fewer than ``support`` occurrences, whatever the shards' sizes,
so none is lost; two phrases with one hash can only make a candidate too many.
The union of the shards' phrases, without those whose counts in all units of the
slice stay below the support, goes back to the units as one bit per phrase.
Pass 3 meets units and bits, and counts these candidates exactly, as words and not as
hashes: per unit with numpy; the units' words and counts go, compressed, to the hash
slices, where equal phrases are added up.
A candidate's parts occur at least as often as it does, so the same table holds
every count that the scores need.

The score of a candidate is floor(10^6 a a / (l r)) of its lowest cut, in DECIMAL(38).
Counts and scores cover all texts; only the report is limited to ``top`` a language.

Defined cases: null texts are empty, null languages are ``und`` (as a language
of that name); repeated rows count each; texts, pieces and words of any length
are taken whole; an empty table gives no rows; other columns are ignored. Ties
go by a, then by the phrase's bytes. Arithmetic is exact up to 10^15 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from . import scratch
from . import textkernel as tk

SHARDS = 4
CHUNK_BYTES = 1 << 15
UNIT_WORDS = 1 << 20
SLICE_PHRASES = 1 << 20
#: Bytes of chunks that wait in a task for the rest of their unit.
OPEN_BYTES = 24 << 20
#: Hash bits beyond those that number all phrases: one phrase in 2^8 or fewer meets another.
SPARE_BITS = 8
#: Parts of a language that are ranked on their own before the last ranking.
PARTS = 8

U64 = np.uint64
_BLANKS = tk.byte_class((0x20, 0x20), (0x09, 0x09))
#: Bytes that end a piece.
_CUTS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_WORD = ~(_BLANKS | _CUTS)


def _schema(names: str) -> T.StructType:
    kinds = {"lang": T.StringType(), "phrase": T.StringType(), "body": T.BinaryType(), "counts": T.BinaryType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in names.split()])


_CHUNKS, _SLICES = _schema("lang part seq words body"), _schema("slice part lang seq size body")
_SHARES, _COUNTS = _schema("slice lang size width body counts"), _schema("lang phrase f")


# Pass 1: texts to chunks


def plain_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The words of the documents, A-Z lowered, each with one byte after it: a line end where its piece ends, else a blank."""
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, off, _WORD)
    if not len(starts):
        return np.zeros(0, np.uint8)
    cuts = np.concatenate([[0], np.cumsum(_CUTS[low])])
    last = np.ones(len(starts), bool)
    last[:-1] = cuts[ends[:-1]] != cuts[starts[1:]]
    last[first[1:][first[1:] > 0] - 1] = True
    after = np.cumsum(ends - starts) + np.arange(len(starts))
    out = np.empty(after[-1] + 1, np.uint8)
    inside = np.ones(len(out), bool)
    inside[after] = False
    out[inside] = low[_WORD[low]]
    out[after] = np.where(last, 10, 32)
    return out


def _chunk_rows(lang, part: int, seqs: dict, body: bytes, chunk_bytes: int):
    data = np.frombuffer(body, np.uint8)
    lines = np.flatnonzero(data == 10) + 1
    a = 0
    while a < len(data):
        b = int(lines[np.searchsorted(lines, min(a + chunk_bytes, len(data)))])
        seq = seqs[lang] = seqs.get(lang, -1) + 1
        run = data[a:b]
        yield lang, part, seq, int((run == 32).sum() + (run == 10).sum()), run.tobytes()
        a = b


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, schema, strict=True)], names=schema.names)


def _to_chunks(chunk_bytes: int):
    def run(batches):
        part, seqs, held, n = TaskContext.get().partitionId(), {}, {}, 0

        def flush(langs):
            rows = [r for lang in langs for r in _chunk_rows(lang, part, seqs, b"".join(held.pop(lang)), chunk_bytes)]
            return _table(rows, _CHUNKS)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).take(pa.array(np.flatnonzero(which == k)))
                for _, _, data, off in tk.pieces(texts):
                    body = plain_words(data, off)
                    held.setdefault(lang, []).append(body.tobytes())
                    n += len(body)
                    if sum(map(len, held[lang])) >= 16 * chunk_bytes:
                        n -= sum(map(len, held[lang]))
                        yield flush([lang])
            if n >= OPEN_BYTES:
                yield flush(list(held))
                n = 0
        yield flush(list(held))

    return run


# Units: the distinct phrases of some chunks


class Unit:
    """The phrases of a run of chunks: for each length the distinct ones, their counts and a place of each, and hashes of all."""

    def __init__(self, lang: str, body: bytes, longest: int):
        data = self.data = np.frombuffer(body, np.uint8)
        apart = (data == 32) | (data == 10)
        self.ends = np.flatnonzero(apart)
        n = len(self.ends)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if n else self.ends
        offsets = np.concatenate([self.starts - np.arange(n), [len(data) - n]]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[~apart])]).dictionary_encode()
        ids, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        same_piece = data[self.ends] == 32
        bytes_, off = tk.text_buffer(words.dictionary)
        name = tk.stretch_hash(tk.prefix_hash(np.frombuffer(lang.encode(), np.uint8)), np.array([0]), np.array([len(lang.encode())]))
        with np.errstate(over="ignore"):
            word_hash = tk.mix(tk.stretch_hash(tk.prefix_hash(bytes_), off[:-1], off[1:]) + name * U64(0x9E3779B97F4A7C15))
        at, now = np.arange(n), ids
        self.length, self.count, self.place, hashes, before = [], [], [], [], None
        for k in range(1, longest + 1):
            if k > 1:
                # a phrase of k words is one of k - 1 words and the word after it
                go = (at + k - 1 < n) & same_piece[np.minimum(at + k - 2, max(n - 1, 0))]
                at, now = at[go], now[go] * size + ids[at[go] + k - 1]
            kinds, first, now, count = np.unique(now, return_index=True, return_inverse=True, return_counts=True)
            with np.errstate(over="ignore"):
                before = word_hash[kinds] if k == 1 else tk.mix(before[kinds // size] * U64(0xD1342543DE82EF95) + word_hash[kinds % size] + U64(k))
            hashes.append(before)
            self.length.append(np.full(len(kinds), k))
            self.count.append(count)
            self.place.append(at[first])
        self.length, self.count, self.place = map(np.concatenate, (self.length, self.count, self.place))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.length, self.count, self.place = hashes[order], self.length[order], self.count[order], self.place[order]

    def lines(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen ones of the phrases as lines, and where the lines start and the last one ends."""
        a = self.starts[self.place[chosen]]
        size = self.ends[self.place[chosen] + self.length[chosen] - 1] - a + 1
        off = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(off[-1]) + np.repeat(a - off[:-1], size)]
        data[off[1:] - 1] = 10
        return data, off


# Pass 2: hash slices of units, and the shards' mining in each slice


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, and counts, both as planes of bytes, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, counts.astype("<u4"))]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(body, 8 * size, codec="zstd", asbytes=True), np.uint8)
    steps, counts = (np.ascontiguousarray(x.reshape(4, size).T).view("<u4")[:, 0] for x in (planes[: 4 * size], planes[4 * size :]))
    return np.cumsum(steps, dtype=np.uint32), counts


def _to_slices(longest: int, unit_words: int, slice_bits: int, bits: int):
    def run(batches):
        held, n = {}, 0

        def flush(key):
            nonlocal n
            seq, _, body = held.pop(key)[:3]
            n -= sum(map(len, body))
            unit = Unit(key[1], b"".join(body), longest)
            values = unit.hash >> U64(64 - bits)
            where = (values >> U64(bits - slice_bits)).astype(np.int64)
            values = (values & U64((1 << (bits - slice_bits)) - 1)).astype(np.uint32)
            edges = np.flatnonzero(np.diff(where, prepend=-1, append=-1 if len(where) else -2))
            rows = [(int(where[a]), key[0], key[1], seq, int(b - a), packed(values[a:b], unit.count[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
            return _table(rows, _SLICES)

        for batch in batches:
            for lang, part, seq, words, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (part, lang)
                if key in held and (held[key][3] != seq - 1 or held[key][1] >= unit_words):
                    yield flush(key)
                first = held.setdefault(key, [seq, 0, [], seq])
                first[1] += words
                first[2].append(body)
                first[3] = seq
                n += len(body)
                while n >= OPEN_BYTES:
                    yield flush(max(held, key=lambda k: held[k][1]))
        for key in list(held):
            yield flush(key)

    return run


def mined(values: list[np.ndarray], counts: list[np.ndarray], shards: np.ndarray, support: int) -> list[np.ndarray]:
    """For each row of a slice, which of its values reach the local support in at least one shard, and the support in all."""
    local = -(-support // SHARDS)
    sizes = [len(v) for v in values]
    flat, count = np.concatenate(values), np.concatenate(counts).astype(np.int64)
    shard = np.repeat(shards, sizes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    edges = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    found = np.zeros(len(edges), bool)
    for s in range(SHARDS):
        found |= np.add.reduceat(np.where(shard[order] == s, count[order], 0), edges) >= local
    found &= np.add.reduceat(count[order], edges) >= support
    chosen = np.empty(len(flat), bool)
    chosen[order] = np.repeat(found, np.diff(edges, append=len(flat)))
    return np.split(chosen, np.cumsum(sizes)[:-1])


def _mine(support: int):
    def run(batches):
        held: list[tuple] = []

        def done():
            got = [unpacked(r[5], r[4]) for r in held]
            shards = np.array([(r[1] * 7 + r[3]) % SHARDS for r in held])
            bits = mined([v for v, _ in got], [c for _, c in got], shards, support)
            return _table([(*r[:5], np.packbits(b).tobytes()) for r, b in zip(held, bits, strict=True)], _SLICES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    return run


# Pass 3: exact counts of the candidates


def planes(counts: np.ndarray) -> bytes:
    """Counts below 2^32 as planes of bytes, compressed."""
    return pa.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _count(longest: int, slice_bits: int):
    def run(batches):
        key, starts, flags, body, last = None, [], {}, [], None

        def done():
            unit = Unit(key[1], b"".join(body), longest)
            chosen = np.flatnonzero(np.concatenate(flags[last]))
            lines, off = unit.lines(chosen)
            where, counts = (unit.hash[chosen] >> U64(64 - slice_bits)).astype(np.int64), unit.count[chosen]
            edges = np.flatnonzero(np.diff(where, prepend=-1, append=-1 if len(where) else -2))
            shares = ((int(where[a]), a, b, lines[off[a] : off[b]].tobytes()) for a, b in zip(edges, edges[1:], strict=False))
            return _table([(s, key[1], int(b - a), len(x), pa.compress(x, codec="zstd", asbytes=True), planes(counts[a:b])) for s, a, b, x in shares], _SHARES)

        for batch in batches:
            for part, lang, seq, _, size, data, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (part, lang) or (text and seq in flags):
                    if body:
                        yield done()
                    body = []
                    if key != (part, lang):
                        key, flags = (part, lang), {}
                if text:
                    last = seq if seq in flags else last
                    body.append(data)
                else:
                    flags.setdefault(seq, []).append(np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool))
        if body:
            yield done()

    return run


def _add(support: int):
    """Shares of slices, each slice's in a row and by language, to the phrases that reach the support."""

    def run(batches):
        key, held = None, []

        def done():
            lines = np.frombuffer(b"".join(pa.decompress(body, width, codec="zstd", asbytes=True) for _, width, body, _ in held), np.uint8)
            counts = [np.frombuffer(pa.decompress(c, 4 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, size).T for size, _, _, c in held]
            n = np.ascontiguousarray(np.concatenate(counts)).view("<u4")[:, 0].astype(np.int64)
            off = np.concatenate([[0], np.flatnonzero(lines == 10) + 1 - np.arange(1, len(n) + 1)]).astype(np.int64)
            texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(lines[lines != 10]))
            sums = pa.table({"phrase": texts, "n": n}).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
            sums = sums.filter(pc.greater_equal(sums["n_sum"], support))
            columns = [pa.array([key[1]] * len(sums), pa.string()), sums["phrase"].cast(pa.string()), sums["n_sum"]]
            return pa.table(columns, names=_COUNTS.names).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and key != row[:2]:
                    yield from done()
                    held = []
                key = row[:2]
                held.append(row[2:])
        if held:
            yield from done()

    return run


def frequent_phrases(docs: DataFrame, support: int, longest: int, text_col: str = "text", lang_col: str = "lang", unit_words: int = UNIT_WORDS, chunk_bytes: int = CHUNK_BYTES, slice_phrases: int = SLICE_PHRASES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to ``longest`` words that occur ``support`` times or more, (lang, n) word counts), both written."""
    spark, path = docs.sparkSession, scratch.new_path(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chunks = scratch.written(texts.mapInArrow(_to_chunks(chunk_bytes), _CHUNKS), f"{path}/chunks")
    words = scratch.written(chunks.groupBy("lang").agg(F.sum("words").alias("n")), f"{path}/words")
    total = longest * (words.agg(F.sum("n")).first()[0] or 0)
    slice_bits = max(total // slice_phrases, 1).bit_length()
    # what a slice holds beyond its own number fits 32 bits
    bits = min(max(total.bit_length() + SPARE_BITS, slice_bits + 1), slice_bits + 32, 64)
    slices = chunks.mapInArrow(_to_slices(longest, unit_words, slice_bits, bits), _SLICES)
    # a row is one unit's share of a slice, and a slice is a bounded part of all phrases
    found = slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_mine(support), _SLICES)
    bits_rows = found.select("part", "lang", "seq", "slice", "size", "body", F.lit(False).alias("text"))
    text_rows = chunks.select("part", "lang", "seq", F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("size"), "body", F.lit(True).alias("text"))
    met = bits_rows.union(text_rows).repartition("part").sortWithinPartitions("part", "lang", "text", "seq", "slice")
    shares = met.mapInArrow(_count(longest, slice_bits), _SHARES)
    # a phrase has one hash and so one slice, which has a bounded part of all phrases here as well
    counts = shares.repartition("slice").sortWithinPartitions("slice", "lang").mapInArrow(_add(support), _COUNTS)
    counts = scratch.written(counts, f"{path}/counts")
    scratch.remove(spark, f"{path}/chunks")
    return counts, words


def scored(phrases: DataFrame, share: int, longest: int | None = None) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate holds ``share`` percent of the time.

    Phrases of ``longest`` words, if it is given, are part of no other and stay out of the lookups.
    """
    cand = phrases.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    cuts = cand.select("lang", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    # the parts alone travel: together they are the phrase
    cuts = cuts.select("lang", "a", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    parts = phrases if longest is None else phrases.filter(F.size(F.split("phrase", " ")) < longest)
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.withColumn("phrase", F.concat_ws(" ", "first", "rest")).withColumn("k", F.size(F.split("first", " ")))
    score = F.expr("cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    inner = (
        cand.filter(F.size("w") > 2)
        .select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
        .select("lang", "f", F.explode(F.expr("transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("x.a"), F.lit(True)))
    return kept.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, top: int = 2000, share: int = 50, **names) -> DataFrame:
    """Each language's first ``top`` candidates: lang, rank, phrase, a, l, r, n, score."""
    phrases, words = frequent_phrases(docs, support, longest, **names)
    first = scored(phrases, share, longest)
    # the best of every part first, so that the last task of a language sees PARTS x top rows at most
    for key in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):
        best = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        first = first.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(table: str, support: int, top: int) -> str:
    """DuckDB text of ``collocations`` for phrases of two and three words and a share of 50 percent."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM {table} WHERE text IS NOT NULL)),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM starts GROUP BY ALL),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {support}),
cuts AS MATERIALIZED (
  SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, 1000000 * c.a * c.a // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked k JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) n ON n.lang = k.lang
WHERE rank <= {top}"""
