import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from particula.llm import suffix_dedup
from particula.llm.suffix_sort import suffix_array


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=400, deadline=None)
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_long_runs():
    for text in ([1] * 3000, [1, 2] * 1500, [2, 1] * 1500, [1, 1, 2, 1, 1, 1, 2] * 300):
        text = [*text, 0]
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, span):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - span + 1):
                s = b[p : p + span]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        goes = [False] * len(b)
        if i is not None:
            for p in range(len(b) - span + 1):
                if first[b[p : p + span]] < i:
                    goes[p : p + span] = [True] * span
        kept = bytes(x for x, g in zip(b, goes) if not g)
        runs = sum(g and (k == 0 or not goes[k - 1]) for k, g in enumerate(goes))
        out.append((i, len(b), sum(goes), runs, kept))
    return sorted(out, key=str)


def _rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    lines = [" ".join(word() for _ in range(r.randint(4, 40))) for _ in range(8)]
    rows = []
    for i in range(70):
        parts = [r.choice(lines) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))]
        text = r.choice(["\n", " "]).join(parts)
        if r.random() < 0.2:
            at = r.randrange(len(text))
            text = text[:at] + "#" + text[at:]
        rows.append((i, text))
    rows += [(100 + k, rows[k][1]) for k in range(0, 30, 4)]
    rows += [(200, None), (201, ""), (202, "ab" * 400), (203, "ab" * 300), (204, "z" * 2000), (205, "z" * 51), (205, "z" * 51), (206, rows[3][1]), (206, rows[4][1]), (None, rows[5][1]), (None, None), (207, rows[1][1][:49]), (-5, rows[2][1])]
    r.shuffle(rows)
    return rows


def _got(df, **kw):
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.dedup(df, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = _rows(seed)
        df = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, id int, key string").repartition(4)
        assert _got(df) == brute(rows, 50)


def test_small_span_small_pieces_and_hot_anchors(spark, monkeypatch):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 12)
    assert _got(df, span=12, gram=5) == want
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 3000)
    assert _got(df, span=12, gram=5) == want
    # every shared anchor held by more than three rows goes string by string
    assert _got(df, span=12, gram=5, hot=3) == want


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_rows_are_worked_out_once(spark):
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(60))
    told = []
    for n in (50, 400):
        rows = [(7, text)] * n + [(3, text[100:300] + "#" + text[310:]), (9, text[:250]), (9, text[:250]), (2, "x" + text[350:])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = brute(list(dict.fromkeys(rows)), suffix_dedup.SPAN)
        got = _got(df)
        assert sorted(set(got), key=str) == want and len(got) == len(rows)
        keyed = df.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), "text")
        size = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.octet_length(x["starts"]))
        told.append(suffix_dedup.met(keyed).agg(F.max(size("told")), F.max(F.coalesce(size("found"), F.lit(0)))).first())
    # what a row is told does not grow with the number of its equals
    assert all(b <= 2 * a + 64 for a, b in zip(*told, strict=True)), told


def test_what_tells_a_text_from_the_others_of_its_group():
    rng = np.random.default_rng(5)
    side = 11
    sizes = rng.integers(0, side + 1, 300)
    of = np.sort(np.concatenate([np.repeat(np.arange(60), 2), rng.integers(0, 60, 180)]))
    # two values, zero among them, so that many texts are equal or begin alike
    data = rng.integers(0, 2, 300 * side).astype(np.uint8)
    first = np.arange(300) * side
    texts = [data[a : a + n].tobytes() for a, n in zip(first, sizes, strict=True)]
    same, far = suffix_dedup._told_apart(data, first, 1, sizes, of, side)
    back, _ = suffix_dedup._told_apart(data, first + sizes - 1, -1, sizes, of, side)

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    for k, t in enumerate(texts):
        others = [texts[i] for i in np.flatnonzero(of == of[k]) if i != k]
        group = [t, *others]
        assert same[k] == min(common(x, y) for i, x in enumerate(group) for y in group[:i])
        assert same[k] + far[k] == min(len(t), max(common(t, x) for x in others) + 1)
        assert back[k] == min(common(x[::-1], y[::-1]) for i, x in enumerate(group) for y in group[:i])
