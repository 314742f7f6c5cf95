import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from particula.llm import decontam, simhash, suffix_dedup, toxicity

from .test_simhash import brute as simhash_brute
from .test_suffix_dedup import brute as repeats_brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = " ".join(word() for _ in range(25))
    item = " ".join(word() for _ in range(30))
    texts = []
    for i in range(300):
        w = [word() for _ in range(r.choice([5, 40, 200]))]
        if i % 10 == 3:
            w[len(w) // 2 : len(w) // 2] = ["vile", "awful", "rotten"]
        if i % 25 == 7:
            w += line.split()
        if i % 30 == 11:
            w += item.split()
        texts.append(" ".join(w))
    texts += [texts[k] for k in (0, 1, 2, 5)] + [texts[40] + " end", "", None, "x" * 5000]
    rows = [(i, t, "en", r.choice(["a", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, item = _docs()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 10 == 3)) for i, *_ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "a b")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, item


def test_stages_against_brute_force(spark, tables):
    at, rows, item = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, at)
    assert kept.schema == docs.schema
    left = sorted(map(tuple, kept.collect()))
    assert [x[0] for x in left] == [x[0] for x in rows if not (x[0] < 300 and x[0] % 10 == 3)]

    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(left, DOCS), at)
    assert got.schema == docs.schema
    stays = {i for i, _, c in simhash_brute([(x[0], x[1]) for x in left]) if i == c}
    left = [x for x in left if x[0] in stays]
    assert sorted(map(tuple, got.collect())) == left

    got = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(left, DOCS), at)
    assert got.schema == docs.schema
    texts = {i: kept.decode() for i, _, _, _, kept in repeats_brute([(x[0], x[1]) for x in left], 50)}
    left = [(x[0], None if x[1] is None else texts[x[0]], *x[2:4], len(texts[x[0]])) for x in left]
    assert sorted(map(tuple, got.collect())) == left

    got = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(left, DOCS), at)
    assert got.schema == docs.schema
    left = [x for x in left if item not in (x[1] or "")]
    assert sorted(map(tuple, got.collect())) == left

    packed = corpus_pipeline.pack(spark, spark.createDataFrame(left, DOCS), at).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {x[0]: len(lib.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in left}
    have = {}
    for p in packed:
        have[p.doc_id] = have.get(p.doc_id, 0) + p.length
    assert have == want

    whole = corpus_pipeline.run(spark, at).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in whole if p.length == p.doc_tokens) and {p.doc_id for p in whole} == set(want)
    assert sum(p.length for p in whole) == sum(want.values())


def test_stages_keep_odd_rows(spark):
    """Null ids and texts, repeated rows and clashing column names pass every filtering stage."""
    schema = DOCS + ", row int, key string, score double, id int"
    odd = [(1, "a b c d e f g", "en", None, 13, 1, "k", 0.5, 9), (1, "a b c d e f g", "en", None, 13, 1, "k", 0.5, 9), (None, "p q r s t u", None, "s", 11, None, None, None, None), (2, None, None, None, None, 2, "", 1.0, 0)]
    df = spark.createDataFrame(odd, schema)
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(str, toxicity.drop_toxic(df, labels).collect())) == sorted(map(str, df.collect()))
    one = simhash.drop_near_duplicates(df).collect()
    assert len(one) == 3 and sorted(map(str, one)) == sorted({str(x) for x in df.collect()})
    assert sorted(map(str, suffix_dedup.cut_repeats(df).collect())) == sorted(map(str, df.collect()))
    bench = spark.createDataFrame([(1, "zz yy xx ww vv uu")], "item_id long, text string")
    assert sorted(map(str, decontam.drop_contaminated(df, bench).collect())) == sorted(map(str, df.collect()))
    for f in (lambda d: toxicity.drop_toxic(d, labels.limit(0)), simhash.drop_near_duplicates, suffix_dedup.cut_repeats, lambda d: decontam.drop_contaminated(d, bench)):
        assert f(df.limit(0)).collect() == []


def test_characters_go_whole(spark):
    shared = "é" * 24 + "a"
    df = spark.createDataFrame([(1, "x" + shared + "y"), (2, "è" + shared + "y"), (3, "b" + shared[1:] + "yé")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in suffix_dedup.cut_repeats(df).collect()}
    assert got == {1: "x" + shared + "y", 2: "", 3: "b" + shared[1:] + "yé"} or got[2] == "è"
