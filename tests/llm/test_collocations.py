import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from particula.llm import collocations as C


def brute(rows, support, longest=3, top=2000, share=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= support}
    out = {}
    for (lang, w), a in cand.items():
        longer = [b for (g, v), b in cand.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, le, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)
    )


def got(df, **kw):
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocab = ["a", "B", "c", "dé", "日本", "x-y", "ß", "the", "The", "q\x85q", " "]
    texts = ["".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(200)]
    out = [(t, r.choice(["en", "de", None, "und", "", "x'"])) for t in texts]
    out += [(None, "en"), ("", None), ("a a a a a a a", "en"), ("  ..", "de")] + [("same words again", "en")] * 40
    return [*out, (" ".join(r.choice(vocab[:4]) for _ in range(4000)), "en")]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(t, g, 1, "k") for t, g in rows], "text string, lang string, n int, phrase string").repartition(5)
    want = brute(rows, 10)
    assert want and got(df, support=10) == want
    # many small units, chunks and slices, several shards
    assert got(df, support=10, unit_words=40, chunk_bytes=64, slice_phrases=50) == want
    assert got(df, support=3, unit_words=200, chunk_bytes=16, slice_phrases=500, top=7) == brute(rows, 3, top=7)
    assert got(df, support=5, longest=4, share=80, unit_words=300, chunk_bytes=100) == brute(rows, 5, 4, share=80)
    assert got(df, support=1, longest=2, unit_words=100) == brute(rows, 1, 2)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert got(empty) == []
    nothing = spark.createDataFrame([(None, None), ("", "en"), (" .,", "en")], "text string, lang string")
    assert got(nothing) == []


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: a a 10^6 and l r."""
    f = [("en", "a", 9 * 10**11), ("en", "b", 8 * 10**11 + 7), ("en", "a b", 7 * 10**11 + 1)]
    out = C.scored(spark.createDataFrame(f, "lang string, phrase string, f long"), 50).collect()
    a, l_, r = 7 * 10**11 + 1, 9 * 10**11, 8 * 10**11 + 7
    assert [tuple(x) for x in out] == [("en", "a b", a, l_, r, 10**6 * a * a // (l_ * r))]


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50), st.integers(0, 10**6))
@settings(max_examples=100, deadline=None)
def test_packed_round_trip(values, count):
    values = np.sort(np.array(values, np.uint32))
    counts = np.full(len(values), count)
    v, c = C.unpacked(C.packed(values, counts), len(values))
    assert (v == values).all() and (c == counts).all()


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4), st.integers(0, 3)), min_size=1, max_size=60), st.integers(2, 12))
@settings(max_examples=200, deadline=None)
def test_mining_loses_nothing(entries, support):
    """What reaches the support over all shards reaches the local support in one of them; nothing else is chosen."""
    entries.sort()
    rows = [[e for e in entries if e[2] == s] for s in range(4)]
    shards = np.array([s for s in range(4) if rows[s]])
    rows = [r for r in rows if r]
    bits = C.mined([np.array([e[0] for e in r], np.uint32) for r in rows], [np.array([e[1] for e in r]) for r in rows], shards, support)
    total = Counter()
    for v, c, _ in entries:
        total[v] += c
    chosen = {e[0] for r, b in zip(rows, bits, strict=True) for e, x in zip(r, b, strict=True) if x}
    assert chosen == {v for v, c in total.items() if c >= support}


def test_counts_travel_compressed_and_lookups_are_short(spark, rows):
    """Pass 3 sends each unit's phrases as compressed lines, not a row a phrase; the longest phrases are in no lookup, which changes nothing."""
    unit = C.Unit("en", b"the word is\nthe word\n" * 4000, 3)
    lines, off = unit.lines(np.flatnonzero(unit.count >= 8000))
    assert sorted(lines.tobytes().split(b"\n")[:-1]) == [b"the", b"the word", b"word"] and off[-1] == len(lines)
    df = spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string")
    phrases, _ = C.frequent_phrases(df, 10, 3, unit_words=40, chunk_bytes=64, slice_phrases=50)
    assert sorted(map(tuple, C.scored(phrases, 50, 3).collect())) == sorted(map(tuple, C.scored(phrases, 50).collect()))


def test_adding_up_of_shares(spark):
    """Shares of one slice: languages apart, equal phrases added beyond 32 bits, those below the support dropped."""
    import pyarrow as pa

    def share(lang, texts, counts):
        body = "".join(f"{t}\n" for t in texts).encode()
        return (0, lang, len(texts), len(body), pa.compress(body, codec="zstd", asbytes=True), C.planes(np.array(counts)))

    big = 2**32 - 1
    given = [share("de", ["a b"], [9]), share("en", ["é x", "a b"], [4, big]), share("en", ["a b", "é x", "w"], [big, 6, 9])]
    out = [tuple(r.values()) for b in C._add(10)([C._table(given[:2], C._SHARES), C._table(given[2:], C._SHARES)]) for r in b.to_pylist()]
    assert sorted(out) == [("en", "a b", 2 * big), ("en", "é x", 10)]
