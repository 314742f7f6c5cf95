"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bfd_pack, bpe_codec, centroids, collocations, decontam, ffd_pack, licenses, maglev, prefix_forest, simhash, suffix_dedup, toxicity, url_filter

Build = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bfd_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_pack.pack(_table(spark, sf_dir, "documents"), word_tokenizer())


def op5_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_pack.pack(_table(spark, sf_dir, "documents"), word_tokenizer())


def op3_prefix_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op7_maglev_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.fit(url_filter.labelled_table(spark)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return done.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_spaced_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), min_item=1)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), support=10, longest=3, top=2000)


CLUSTERS = {"k": 8, "rounds": 10, "dims": 64, "scale": 1024, "seed": 3}


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"), **CLUSTERS)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.round_trip(_table(spark, sf_dir, "documents"), word_tokenizer())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Build]:
    found = (
        op1_bfd_token_matrix,
        op2_toxicity_ftrl,
        op3_prefix_forest_search,
        op4_spaced_seed_decontam,
        op5_ffd_packing,
        op6_license_scan,
        op7_maglev_shards,
        op8_url_filter,
        op9_simhash_near_dedup,
        op10_suffix_dedup,
        op11_phrase_collocations,
        op12_centroid_clustering,
        op13_bpe_codec,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_maglev_shards": maglev.oracle_sql(SHARDS, maglev.SIZE, "documents", "doc_id"),
        "op11_phrase_collocations": collocations.oracle_sql("documents", support=10, top=2000),
        "op12_centroid_clustering": centroids.oracle_sql("embeddings", **CLUSTERS),
    }
