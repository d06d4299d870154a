"""The operators as queries on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.llm import (
    conversation_repair,
    exact_dedup,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    near_vectors,
    ngram_join,
    packing,
    sharding,
    substring_dedup,
    url_filters,
    vector_packing,
)
from fieldstats.llm.common import table
from fieldstats.llm.oracles import ORACLES

#: Fixed by the contract of op10: (host, path, verdict).
LISTED = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer file that a contract names; every executor has the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_texts(table(spark, sf_dir, "documents"), "doc_id", "text", k=4, num=85, den=100)


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shard_rows(rows, ["doc_id"], [1.0] * 8, grown=[1.0]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def op3_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, "doc_id", "text").select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256")
    )


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_runs(docs, "doc_id", "text").select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_groups(docs, "doc_id", exact_dedup.normalised(F.col("text"))).withColumnRenamed(
        "digest", "text_sha256"
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, "doc_id", "source", mixing.word_count(F.col("text")), [3, 1, 2], 1.5).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    )
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", labels, LISTED).select(
        "page_id", "host", "path", "rule", "verdict", "mined_rule"
    )


def op6_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, "doc_id", "text", tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.fold_of("doc_id", 4) == 2
    model = language_id.fit(docs.filter(~held_out), "doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), "doc_id", "text", model).drop("text")


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return vector_packing.pack_texts(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"))


def op12_edit_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    damaged = conversation_repair.damage(turns, "conv_id", "turn", "role", "text")
    return conversation_repair.repair(damaged, turns.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own))
    return hard_negatives.mine(rows, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)


__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_rendezvous_sharding,
        op3_subspace_pigeonhole,
        op4_line_chunks,
        op4_line_runs,
        op5_exact_dedup,
        op6_minimum_slack_packing,
        op7_source_mixing,
        op8_language_ppm,
        op9_substring_dedup,
        op10_url_rules,
        op11_vector_packing,
        op12_edit_lattice_repair,
        op13_residue_negatives,
    )
}
