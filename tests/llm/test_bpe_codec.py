import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from particula.llm import bpe_codec
from particula.llm.bpe_codec import Codec, Merges

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "",
    None,
    "Hello, WORLD don't we're it'S",
    "é é ñandú İstanbul ΣΑΣ x’s ŐŰ",
    "a<|endoftext|>b <|startoftext|><|endoftext|>",
    "1234 ½² ª\x1c z \x85   q",
    "x" * 9000,
    "ab" * 3000 + "c",
    "日本語 text 한국어 ไทย",
    "tab\tnew\nline\r\n  end ",
    "\x00 zero \x00a",
    "</w> w</w> <|endof",
    "   ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_codec_equals_the_library(library, codec):
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice("abcdeé'strlm ,.|1_ßÄ") for _ in range(300)) for _ in range(300)]
    for got, text in zip(codec.encode_batch(texts) + codec.encode_batch(texts), texts * 2, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids_of(got) == want
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_any_text(texts):
    library, codec = _shared()
    for got, text in zip(codec.encode_batch(texts), texts, strict=True):
        assert ids_of(got) == library.encode(text, add_special_tokens=False).ids


_kept = []


def _shared():
    if not _kept:
        _kept.extend([Tokenizer.from_file(PATH), Codec(PATH)])
    return _kept


def plain_merges(word, merges):
    """Brute force: the lowest merge, the leftmost of equal ones, until none is left."""
    parts = list(word)
    while True:
        found = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.integers(0, 10**6), st.integers(2, 3), st.integers(0, 14))
@settings(max_examples=300, deadline=None)
def test_guess_and_check_on_random_merges(seed, letters, count):
    """Merges of few letters clash often; every word up to eight letters against brute force, guessed or not."""
    r = random.Random(seed)
    vocab = {c: i for i, c in enumerate("abc"[:letters])}
    merges = []
    for _ in range(count):
        a, b = r.choice(list(vocab)), r.choice(list(vocab))
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    ranks = {m: i for i, m in enumerate(merges)}
    own = Merges({"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]})
    words = ["".join(r.choice("abc"[:letters]) for _ in range(r.randint(1, 12))) for _ in range(120)]
    names = {i: t for t, i in vocab.items()}
    for word, got in zip(words, own.encode_words(words), strict=True):
        assert [names[i] for i in got] == plain_merges(word, ranks)
        assert [names[i] for i in own.exact(word)] == plain_merges(word, ranks)
    for token, i in vocab.items():
        assert own.sound[i] == (plain_merges(token, ranks) == [token])


def test_merges_out_of_order_and_double():
    """A merge before one that it needs, and two merges for one token: nothing is guessed, the result is right."""
    for merges in ([("ab", "c"), ("a", "b"), ("b", "c")], [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]):
        vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
        own = Merges({"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]})
        ranks = {m: i for i, m in enumerate(merges)}
        words = ["abc", "aabcc", "bcabc", "cabab"]
        names = {i: t for t, i in vocab.items()}
        assert [[names[i] for i in x] for x in own.encode_words(words)] == [plain_merges(w, ranks) for w in words]


def test_only_failing_words_are_merged(codec):
    """Most words of prose are right at the first guess."""
    words = "the measurement of particulate matter in the city shows a seasonal course".split()
    codec.merges.encode_words(words)
    assert codec.merges.failed <= len(words) // 3


def test_memory_is_bounded(codec, monkeypatch, library):
    own = Codec(PATH)
    monkeypatch.setattr(bpe_codec, "MEMORY", 2000)
    for k in range(30):
        text = f"alpha{k} beta{k} gamma{k}"
        assert ids_of(own.encode_batch([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert own.known_bytes <= 2000


def test_other_models_are_refused(tmp_path):
    spec = json.loads(open(PATH).read())
    with pytest.raises(ValueError):
        Merges(spec["model"] | {"dropout": 0.1})


def test_tables(spark, library, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y", 2), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bpe_codec.round_trip(df, PATH).collect()
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows), key=str)
    assert sorted(((x.doc_id, ids_of(x.ids)) for x in got), key=str) == want
    assert all(x.decoded == library.decode(ids_of(x.ids), skip_special_tokens=False) for x in got)
    tokens = bpe_codec.encode(df, PATH)
    back = bpe_codec.decode(tokens, PATH).collect()
    assert sorted((str(x.doc_id), x.decoded) for x in back) == sorted((str(x.doc_id), x.decoded) for x in got)
    assert bpe_codec.round_trip(df.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(1, None), (2, bytearray(np.array([5, 10**6, 256], "<u4").tobytes()))], "doc_id long, ids binary")
    assert sorted(bpe_codec.decode(odd, PATH).collect(), key=lambda x: x.doc_id) == [(1, None), (2, library.decode([5, 256], skip_special_tokens=False))]


def test_query(spark, library):
    import hashlib

    from particula.llm.queries import op13_bpe_codec

    got = op13_bpe_codec(spark, "/root/testdata/sf0.001").collect()
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for x in got:
        ids = library.encode(docs[x.doc_id], add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
