import random
from fractions import Fraction
from itertools import combinations

import numpy as np

import corpus_pipeline
from particula.llm import decontam, queries


def _words(n, r):
    return ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def _case(seed=5):
    r = random.Random(seed)
    items = [(i, _words(r.choice([6, 9, 14, 40, 80]), r)) for i in range(30)]
    docs, planted = [], set()
    for d in range(200):
        w = _words(r.choice([0, 3, 30, 300]), r)
        if d % 3 == 0:
            i, passage = r.choice(items)
            if d % 2:
                passage = list(passage)
                if len(passage) >= 14:  # one word in nine substituted
                    for k in range(4, len(passage) - 1, 9):
                        passage[k] = "other"
            at = r.randint(0, len(w))
            w[at:at] = passage
            planted.add((d, i))
        docs.append((d, r.choice([" ", "\n", ", "]).join(w).upper() if d % 5 else " ".join(w)))
    return docs, [(i, " ".join(w)) for i, w in items], planted


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, items, planted = _case()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.overlaps(d, b)
    assert got.schema["item_id"].dataType.simpleString() == "int"
    assert {(r.doc_id, r.item_id) for r in got.collect()} == planted
    assert all(r.n_equal >= 0.8 * r.n_words for r in got.collect())
    # small blocks of the benchmark find the same
    blocks = decontam.overlaps(d, b, block_bytes=500)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got.collect()))
    kept = {r.doc_id for r in decontam.drop_contaminated(d, b, block_bytes=500).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in planted}


def test_every_overlap_at_a_shared_window(spark):
    """Against brute force: whatever shares a full 12-word window is reported with its longest exact stretch."""
    r = random.Random(2)
    item = _words(30, r)
    docs = [(k, " ".join(_words(5, r) + item[k : k + 14] + _words(4, r))) for k in range(17)]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.doc_word, x.item_word, x.n_words) for x in got) == [(k, 9, 5, k, 14) for k in range(17)]


def test_odd_inputs(spark):
    schema = "doc_id long, text string, item_id string, similarity double"
    docs = spark.createDataFrame([(1, None, "x", 0.0), (2, "", None, None), (None, "a b c d e f", "q", 1.0), (2, "a b c d e f", "q", 1.0), (2, "a b c d e f", "q", 1.0), (3, "z " * 50000, "", 0.5)], schema)
    bench = spark.createDataFrame([(1, "A, b. c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "a b"), (None, "z z z z z")], "item_id long, text string")
    got = decontam.overlaps(docs, bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in got if x.doc_id == 2) == [(2, 1)] * 4
    assert sum(x.doc_id is None for x in got) == 2
    assert len([x for x in got if x.doc_id == 3 and x.item_id is None]) == 49996
    assert decontam.overlaps(docs.limit(0), bench).collect() == []
    assert decontam.overlaps(docs, bench.limit(0)).collect() == []
    left = decontam.drop_contaminated(docs, bench)
    assert left.schema == docs.schema and sorted(x.text or "" for x in left.collect()) == ["", ""]


def brute(doc, item, offset, min_words=12, similarity=0.8):
    """Length of the longest stretch on the diagonal that qualifies, or 0."""
    a, b = max(0, -offset), min(len(item), len(doc) - offset)
    same = [item[k] == doc[k + offset] for k in range(a, b)]
    need, share = min(min_words, len(item)), Fraction(str(similarity))
    sizes = [j - i for i in range(len(same)) for j in range(i + need, len(same) + 1) if sum(same[i:j]) >= share * (j - i)]
    return max(sizes, default=0)


def test_verify_against_every_stretch():
    r = random.Random(8)
    for case in range(1500):
        item = _words(r.choice([5, 8, 12, 13, 15, 20, 24, 40]), r)
        copy = [w if r.random() > 0.2 else "other" for w in item]
        if case == 0:
            item = _words(15, r)
            copy = [*item[:11], "other", *item[12:]]
        doc = _words(r.choice([0, 3]), r) + copy + _words(r.choice([0, 3]), r)
        index = decontam.Index([1], [" ".join(item)])
        words = decontam.Index([1], [" ".join(doc)]).hashes
        for offset in (0, 3):
            want = brute(doc, item, offset)
            got = index.verify(words, 0, offset, 12, 0.8)
            assert (got is not None) == (want > 0), (item, doc, offset)
            if got:
                start, place, n, equal = got
                assert start - place == offset and min(12, len(item)) <= n <= want and 5 * equal >= 4 * n
                assert equal == int(np.sum(index.hashes[place : place + n] == words[start : start + n]))


def test_seeds_fit_every_pattern_of_substitutions():
    """Stretches of 24 words or more have a half that qualifies."""
    for n in range(12, 24):
        full = (1 << n) - 1
        left = np.array([full - sum(1 << k for k in out) for out in combinations(range(n), n // 5)])
        for mask in decontam.masks(n, 12, 0.8):
            m = int(mask[::-1], 2)
            for at in range(n - len(mask) + 1):
                left = left[left >> at & m != m]
        assert not len(left), n


def test_hits_are_all_overlaps():
    """Every diagonal that holds an overlap, against brute force over all stretches; also at other lengths and shares."""
    r = random.Random(3)
    for min_words, similarity in [(12, 0.8), (15, 0.9), (6, 0.8), (12, 0.7), (7, 0.6), (20, 0.75)]:
        items = [_words(r.choice([20, 21, 24, 30, 45]), r) for _ in range(12)]
        items += [[*"ababababababababababab"], ["z"] * 25]
        docs = []
        for _ in range(60):
            item = r.choice(items)
            a = r.randint(0, 8)
            copy = [w if r.random() > r.choice([0.1, 0.2]) else "other" for w in item[a : a + r.randint(10, 45)]]
            docs.append(_words(r.choice([0, 4]), r) + copy + _words(r.choice([0, 4]), r))
        docs += [["z"] * 40, [], [*"abababababababab"]]
        index = decontam.Index(list(range(len(items))), [" ".join(x) for x in items], min_words, similarity)
        other = decontam.Index([None] * len(docs), [" ".join(x) for x in docs])
        want = [(d, i, at) for d, doc in enumerate(docs) for i, item in enumerate(items) for at in range(-len(item), len(doc)) if set(item) & set(doc) and brute(doc, item, at, min_words, similarity)]
        assert [tuple(x) for x in index.hits(other.hashes, other.first).tolist()] == want


def test_short_items_tolerate_substitutions_too():
    """Every choice of words to substitute, for items below the minimum length."""
    r = random.Random(6)
    for n in range(1, 12):
        for similarity in (0.8, 0.6):
            item = _words(n, r)
            index = decontam.Index([1], [" ".join(item)], 12, similarity, min_item=1)
            allowed = n - -(-n * int(similarity * 10) // 10)
            for k in range(allowed + 2):
                for out in combinations(range(n), min(k, n)):
                    doc = ["before", *("other" if j in out else w for j, w in enumerate(item)), "after"]
                    words = decontam.Index([1], [" ".join(doc)])
                    assert len(index.hits(words.hashes, words.first)) == (k <= allowed), (n, similarity, out)


def test_queries_search_items_of_few_words_and_unspaced_scripts(spark, tmp_path):
    chinese = "山上的小村庄在清晨被薄雾笼罩着老人们坐在树下喝茶"
    items = [(1, "Qu'est-ce"), (2, "one two three four"), (3, chinese), (4, "ร้านกาแฟเล็กๆริมแม่น้ำ"), (5, "five words are in here"), (6, "犬"), (7, "...")]
    texts = ["that is qu est CE, no", "One, two\nthree four!", "x one two three five", "据说" + chinese.replace("清", "今").replace("茶", "酒") + "。后来", "ที่ร้านกาแฟเล็กๆริมแม่น้ำมี", "five words were in here", "b犬c", "..."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in queries.op4_spaced_seed_decontam(spark, str(tmp_path)).collect()}
    assert got == {(0, 1), (1, 2), (3, 3), (4, 4), (5, 5), (6, 6)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id for x in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()} == {2, 7}


def test_characters_of_unspaced_scripts_are_words():
    found = lambda text: len(decontam.Index([1], [text]).hashes)
    for text, n in [("año élan", 2), ("a中b文", 4), ("中文", 2), ("カタカナ ひらがな", 8), ("ไทย", 3), ("𠀀𠀁x", 3), ("привет мир", 2), ("한국어 말", 2), ("中", 1), ("", 0)]:
        assert found(text) == n, text


def test_a_copy_with_two_words_changed_is_found(spark):
    r = random.Random(4)
    item = _words(20, r)
    doc = [*item[:9], "one", "two", *item[11:]]
    d = spark.createDataFrame([(1, " ".join(doc)), (2, "clean text")], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(x) for x in decontam.overlaps(d, b).collect()] == [(1, 7, 0, 0, 20, 18, 0.9)]
    assert [x.doc_id for x in decontam.drop_contaminated(d, b).collect()] == [2]
