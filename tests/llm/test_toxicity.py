import random

import pytest

from particula.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(0)
    vocab = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(r.choice([3, 30, 300]))]
        toxic = i % 6 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["vile", "rotten"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    want = dict(map(tuple, labels.collect()))
    assert got.keys() == want.keys()
    held = [r for r in got.values() if r.held_out]
    assert 150 < len(held) < 300 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_labels_and_other_columns_do_not_matter(spark, corpus):
    """Turning the labels of held-out rows, or adding columns, leaves every score as it is."""
    from pyspark.sql import functions as F

    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(1))
    more = docs.withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x")).withColumn("y", F.lit(0))
    a = sorted(map(tuple, toxicity.judge(docs, labels).collect()))
    assert sorted(map(tuple, toxicity.judge(more, turned).collect())) == a


def test_long_texts_and_odd_rows(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit_held_out(docs, labels)
    long = " ".join(["abcd"] * 60000)
    rows = [(1, long), (2, long + " vile rotten vile"), (3, None), (4, ""), (None, "vile"), (5, "VILE"), (5, "VILE")]
    got = [(r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    by = {}
    for i, s in got:
        by.setdefault(i, []).append(s)
    assert by[1][0] < 0.3 < by[2][0] and by[3] == by[4] and len(by[5]) == 2 and by[5][0] == by[None][0] > 0.3
    assert toxicity.judge(docs.limit(0), labels).collect() == []
    assert all(r.score < 0.01 for r in toxicity.judge(docs.limit(5), labels.limit(0)).collect())


def test_a_bounded_sample_is_learned_from(corpus):
    docs, labels = corpus
    small = toxicity.fit_held_out(docs, labels, max_rows=200)
    assert len(small["place"]) < len(toxicity.fit_held_out(docs, labels)["place"]) + 200


def test_one_label_only(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "doc_id long, text string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, toxic) for i in range(8)], "doc_id long, toxic int")
        got = toxicity.judge(docs, labels).collect()
        assert len(got) == 8 and all(x.predicted == toxic for x in got)
