import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from particula.llm import bfd_pack, ffd_pack
from particula.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 70), max_size=60))
@settings(max_examples=200, deadline=None)
def test_first_fit_decreasing(sizes):
    pieces = [ffd_pack.Piece(d, 0, n) for d, n in enumerate(sizes) if n <= 32]
    want = []
    for p in sorted(pieces, key=lambda p: (-p.size, p.doc)):
        for b in want:
            if sum(x.size for x in b) + p.size <= 32:
                b.append(p)
                break
        else:
            want.append([p])
    assert ffd_pack.first_fit(pieces, 32) == want
    packed = ffd_pack.pack_group(sizes, 32)
    seen = sorted((p.doc, i) for b in packed for p in b for i in range(p.start, p.start + p.size))
    assert seen == [(d, i) for d, n in enumerate(sizes) for i in range(n)]
    used = [sum(p.size for p in b) for b in packed]
    assert all(0 < u <= 32 and u & (u - 1) == 0 for u in used)


@given(st.lists(st.integers(1, 70), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing(sizes):
    pieces = [ffd_pack.Piece(d, 0, n) for d, n in enumerate(sizes) if n <= 32]
    got = bfd_pack.best_fit(pieces, 32)
    free = []
    for p in sorted(pieces, key=lambda p: (-p.size, p.doc)):
        fits = [f for f in free if f >= p.size]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - p.size)
        else:
            free.append(32 - p.size)
    assert sorted(32 - sum(p.size for p in b) for b in got) == sorted(free)


TEXTS = ["", None, "Hello, WORLD don't we're it'S", "é é ñandú İstanbul ΣΑΣ x’s", "a<|endoftext|>b", "1234 ½² ª\x1c z", "x" * 9000, "日本語 text", "tab\tnew\nline\r\n  end "]


def test_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(PATH), Encoder(PATH, 1)
    r = random.Random(0)
    texts = [t for t in TEXTS if t] + ["".join(r.choice("abcdeé'strlm ,.|1_ßÄ") for _ in range(200)) for _ in range(200)]
    for t in texts * 2:
        assert own(t).tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1]
    for name in ("byte_bpe_50k.json",):
        lib, own = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
        assert own(TEXTS[2]).tolist() == lib.encode(TEXTS[2], add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(i, t) for i, t in enumerate(TEXTS + [" ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(r.choice([1, 40, 900]))) for _ in range(150)])] + [(5, "same"), (5, "same"), (None, "no id")]


def _check_pieces(got, rows, lib):
    want = {}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault((i, len(ids)), []).append(ids)
    by_doc, by_seq = {}, {}
    for x in got:
        by_doc.setdefault((x.doc_id, x.doc_tokens), []).append(x)
        by_seq.setdefault(x.sequence_id, []).append(x)
    assert by_doc.keys() == want.keys()
    for key, pieces in by_doc.items():
        ids = np.array(want[key][0], "<u4")
        assert sum(x.length for x in pieces) == len(ids) * len(want[key])
        if len(want[key]) == 1:
            at = 0
            for x in sorted(pieces, key=lambda x: x.start):
                assert x.start == at and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
                at += x.length
    for pieces in by_seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048 and at & (at - 1) == 0


def test_ffd_pack(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, id string")
    lib = Tokenizer.from_file(PATH)
    for kw in ({"group_tokens": 3000, "partitions": 3}, {}):
        _check_pieces(ffd_pack.pack(df, PATH, **kw).collect(), rows, lib)
    assert ffd_pack.pack(df.limit(0), PATH).collect() == []


def test_bfd_round_trip(spark, rows, scratch):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bfd_pack.write(bfd_pack.pack(df, PATH, group_tokens=3000), f"{scratch}/m")
    parts = {}
    for x in spark.read.parquet(f"{scratch}/m").collect():
        ids = np.frombuffer(x.ids, "<u4")
        assert len(ids) == 2048 and x.cu_seqlens[-1] == x.used and x.resets == x.cu_seqlens[:-1] and not ids[x.used :].any()
        pos = bfd_pack.positions(x.cu_seqlens, 2048)
        assert len(pos) == 2048 and all(pos[r] == 0 for r in x.resets)
        for d, s, a, b in zip(x.doc_ids, x.doc_starts, x.cu_seqlens, x.cu_seqlens[1:], strict=False):
            parts.setdefault(d, []).append((s, ids[a:b].tolist()))
    lib = Tokenizer.from_file(PATH)
    for i, t in rows:
        if i not in (5, None):
            assert sum((p for _, p in sorted(parts[i])), []) == [*lib.encode(t or "", add_special_tokens=False).ids, 1]
    assert len(parts[5]) == 3 and len(parts[None]) == 1
