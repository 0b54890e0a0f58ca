"""From raw documents to packed training sequences: five stages, each written as Parquet and reread.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last
one returns the packed pieces. Language ID drops documents without a letter or of no
learned language; line dedup takes out cross-site boilerplate lines and drops documents of which nothing
else is left; the n-gram Jaccard join leaves one document of each group of near copies; mixing
repeats or leaves out documents so that the sources meet their target weights; best-fit packing
places their tokens into sequences.

Defined cases: a row with a null text has no language and goes; null ids and sources are kept as they are;
rows are told apart by all they hold, so rows of one id are documents of their own and of rows equal in
everything one stays after the near-copy stage; texts of any length go through whole, a row a task; ties go as the operators say; an empty table gives no rows;
columns that documents has beyond the usual ones pass through the stages, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import jaccard_join, language_id, line_dedup, mixing, packing
from tidewire.llm.queries import tokenizer_path
from tidewire.llm.shingles import columns
from tidewire.runtime import drop_paths, settle, settled, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and enough letter trigrams that a learned language knows."""
    model = language_id.with_rejection(language_id.fit(docs), docs)
    scored = language_id.with_language(docs, model, pred="_pred", score="_score", known="_known")
    if model is None:  # nothing to learn from: only texts without letters go
        return scored.where(F.col("text").rlike(r"\p{L}")).select(*columns(docs))
    return scored.where((F.col("_pred") != "und") & F.col("_known")).select(*columns(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars"))).select(*columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# training, sketches and the tokenizer are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    before = set(settled(spark))
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        drop_paths(spark, settled(spark) - before - {docs._settled_at})  # what the stage wrote on its way, and its input
    return docs
