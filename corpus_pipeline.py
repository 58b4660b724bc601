"""The corpus pipeline: five stages, each one of the corpus operators, from raw documents to a training mix.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, dedup, language, mixing, neardup
from tracelake.llm._spark import crc_bucket, drop_shared, small_batches, table, write_shared

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: null texts and texts without a letter."""
    small_batches(spark)
    model = language.fit_language_model(docs, crc_bucket(F.col("doc_id"), 3) != 1)
    if not model.langs:  # nothing to learn from: only the letters decide
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])  # columns may be named like results
    found = language.identify(plain, model, text_col=f"c{docs.columns.index('text')}").where("lang_pred <> 'und'")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 of five-word shingles, the one with the smallest id."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of over 50 words that stand in more than one place; documents of which nothing is left go."""
    small_batches(spark)
    names = docs.columns
    cut = dedup.remove_repeats(docs.withColumn("__before", F.length("text")), window=dedup.PASSAGE, unit=dedup.WORDS)
    changed = F.coalesce(F.length("text") < F.col("__before"), F.lit(False))  # null texts are untouched
    kept = cut.where(~changed | (F.length(F.trim("text")) > 0))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a verbatim run of 13 words of a benchmark item, or 5 % words of shorter items."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), any_window=True)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with size, source_size, target and the words taken of each."""
    small_batches(spark)
    return mixing.mix_sources(docs, keep=docs.columns).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can't express SuperMinHash groups, suffix windows and balanced sampling at once; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
        if read is not None:
            drop_shared(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
