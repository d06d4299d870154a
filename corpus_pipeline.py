"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns what it keeps;
all but the last keep the columns of documents. ``n_chars`` follows the text.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.llm import language_id, line_dedup, mixing, ngram_join, packing
from fieldstats.llm.common import SPACE, IdFilter, gathered, settled, table
from fieldstats.llm.queries import tokenizer_path

#: Bits per byte beyond which no learned language explains a text; random bytes have 8.
MOST_BITS = 6.0


def _as(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of the text as it is now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def _keeps_columns(stage):
    """The stage on docs whose columns with a leading underscore are renamed meanwhile."""

    @wraps(stage)
    def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"kept{c}" for c in docs.columns if c.startswith("_")}
        out = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in away.items()})

    return kept


@_keeps_columns
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, without a letter, or explained by none."""
    model = language_id.fit(docs, "doc_id", "text", "lang")
    judged = language_id.identify(docs, "doc_id", "text", model)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS)).select(*docs.columns)


@_keeps_columns
def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts chunks of lines that an earlier document, or an earlier place, has, and the lines
    around them, and runs without a whole chunk, that it has too."""
    return _as(docs, line_dedup.dedup_runs(docs, "doc_id", "text"))


@_keeps_columns
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: five words, similarity 0.8."""
    groups = ngram_join.near_texts(docs.select("doc_id", "text"), "doc_id", "text", k=5, num=80, den=100)
    copies = gathered(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    # What the filter does not hold is no copy; only the rest is shuffled to be compared.
    doubtful = docs.withColumn("_may", F.coalesce(IdFilter(copies, "doc_id").may_hold(F.col("doc_id")), F.lit(True)))
    clear = doubtful.filter(~F.col("_may")).select(*docs.columns)
    return clear.unionByName(doubtful.filter("_may").join(copies, "doc_id", "left_anti").select(*docs.columns))


@_keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts or leaves out documents as the sources' targets ask.

    A document that is taken n times is in n rows; one that a block cuts gives a row of the
    words taken, joined by spaces.
    """
    rows = docs.withColumn("_xx", F.xxhash64("text")).withColumn("_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.hex("_xx")))
    size = mixing.word_count(F.col("text"))
    taken = mixing.mix_sources(rows, "_key", "source", size, [3, 1, 2], 1.5).groupBy("_key").agg(
        F.max("size").alias("_size"), F.min("taken").alias("_taken")
    )
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.greatest("_size", F.lit(1))))
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    part = F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")
    mixed = (
        rows.join(taken.filter(F.col("_taken") > 0), "_key")
        .withColumn("_copy", F.explode(copies))
        .withColumn("text", F.when(left < F.col("_size"), part).otherwise(F.col("text")))
    )
    return _as(docs, mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence of at most 4,096 tokens and their place in it."""
    return packing.pack_documents(docs, "doc_id", "text", tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", remove_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language models, near-copy groups and tokenizers are beyond SQL; tests/llm compare the
#: stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = settled(docs)
    return docs
