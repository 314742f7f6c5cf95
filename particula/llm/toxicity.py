"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. A text's features are its distinct words, word pairs and word pairs
with one and with two words left out, hashed to ``2**BITS`` places. ``fit``
learns from a bounded sample of the labelled rows (``max_rows`` documents,
chosen by a hash of the id): one task runs FTRL-proximal with per-coordinate
rates and L1 in a fixed order of rows over a few epochs. (With more ``shards``
the sample is dealt over as many tasks, whose weights are averaged; on the given
tables that finds fewer of the rare words.) L1 leaves few weights; they go to the
driver (at most ``2**BITS`` numbers whatever the input) and are broadcast for
``score``, which reads every whole text once without a shuffle.

Defined cases: a null or empty text scores the bias alone; repeated rows are
scored one by one; a label that is null takes no part in learning; unless
both labels occur nothing is learned and every score is about 0; an empty table
gives no rows; columns beyond id and text are ignored by the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K

BITS = 20
#: Documents learned from at most (in expectation; a hash of the id chooses them).
MAX_ROWS = 16_000
SHARDS = 1
EPOCHS = 4


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: rate of a coordinate is alpha / (beta + sqrt(sum of squared gradients)); l1, l2: penalties."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0


def _places(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every word, pair and skip-gram of a piece, repeats included."""
    doc = K.owner(first)
    docs, places = [doc], [hashes >> K.U64(64 - BITS)]
    scale = K.U64(0x9FB21C651E98DF25)
    for gap in (1, 2, 3):
        if len(hashes) > gap:
            same = doc[gap:] == doc[:-gap]
            both = K.mix(hashes[:-gap] * scale + hashes[gap:] + K.U64(gap))
            docs.append(doc[:-gap][same])
            places.append((both >> K.U64(64 - BITS))[same])
    return np.concatenate(docs), np.concatenate(places).astype(np.int64)


def _features(text: pa.Array):
    """For each document of a column its distinct places, in order."""
    for _, _, data, off in K.pieces(text):
        doc, place = _places(*K.word_hashes(data, off))
        both = np.unique((doc << BITS) | place)
        cut = np.searchsorted(both, np.arange(len(off)) << BITS)
        for d in range(len(off) - 1):
            yield (both[cut[d] : cut[d + 1]] & ((1 << BITS) - 1)).astype(np.int32)


class Learner:
    """FTRL-proximal state; the place after the last holds the bias, which has no L1."""

    def __init__(self, how: Ftrl):
        self.how = how
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n, how = self.z[places], self.n[places], self.how
        l1 = np.where(places == 1 << BITS, 0.0, how.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))

    def learn(self, places: np.ndarray, label: float) -> None:
        w = self.weights(places)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.how.alpha * w
        self.n[places] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, shards: int = SHARDS, epochs: int = EPOCHS, how: Ftrl = Ftrl()) -> dict[str, np.ndarray]:  # noqa: B008
    """Compact weights: ``place`` (sorted) and ``weight``; the last place is the bias.

    The choice is made on the labels' ids, so only a list of about ``max_rows``
    ids is broadcast to the documents. Repeated labels of an id count once, the
    largest. A learning task holds about max_rows / shards documents.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    # a share of the hash range, in whole numbers, so that the choice is the same everywhere
    n, low, high = known.agg(F.count("*"), F.min("y"), F.max("y")).first()
    if low == high:
        # one label only: every text has it; without labels none is toxic
        return {"place": np.array([1 << BITS]), "weight": np.array([35.0 if low == 1 else -35.0])}
    share = int(1_000_000 * min(1.0, max_rows / n))
    ids = known.withColumn("o", F.xxhash64(F.col("id").cast("string"), F.lit("toxicity sample"))).where(F.pmod("o", F.lit(1_000_000)) < share)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    chosen = chosen.select("o", "text", "y", F.pmod(F.shiftright("o", 24), F.lit(shards)).cast("int").alias("shard"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "text"], kind="stable", na_position="first")
        learner, bias = Learner(how), np.array([1 << BITS], np.int32)
        found = [np.concatenate([p, bias]) for p in _features(pa.array(rows["text"], pa.string()))]
        for _ in range(epochs):
            for places, y in zip(found, rows["y"], strict=True):
                learner.learn(places, y)
        w = learner.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        del found, learner
        K.release()
        return pd.DataFrame({"place": at.astype(np.int64), "weight": w[at] / shards})

    weights = chosen.groupBy("shard").applyInPandas(learn, "place long, weight double")
    got = weights.groupBy("place").agg(F.sum("weight").alias("weight")).orderBy("place").toPandas()
    return {"place": got["place"].to_numpy(np.int64), "weight": got["weight"].to_numpy(np.float64)}


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """(id, score): the probability of label 1 for every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        weights = np.zeros((1 << BITS) + 1)
        weights[sent.value["place"]] = sent.value["weight"]
        bias, used = weights[-1], weights != 0
        for batch in batches:
            sums = []
            for _, _, data, off in K.pieces(batch.column(1)):
                doc, place = _places(*K.word_hashes(data, off))
                hit = used[place]
                both = np.unique((doc[hit] << BITS) | place[hit])
                sums.append(np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], len(off) - 1))
            total = bias + (np.concatenate(sums) if sums else np.zeros(0))
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=[id_col, out])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(out, T.DoubleType())])
    return K.short_batches(docs).select(id_col, text_col).mapInArrow(K.tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """The rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_held_out(docs: DataFrame, labels: DataFrame, **how) -> dict[str, np.ndarray]:
    """Model learned from the labelled documents outside the held-out rows."""
    return fit(docs, labels.where(~held_out()), **how)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs, fit_held_out(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, with all their columns and in one pass over them.

    The score is computed beside the row, so that repeated and null ids need no join.
    """
    model = fit_held_out(docs, labels)
    fields = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.col("text").alias("text"))
    return score(packed, model, "row", "text").where(F.col("score") < threshold).select("row.*")
