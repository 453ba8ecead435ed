"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontamination, language, neardup, secrets
from ledgerloom.llm.common import written
from ledgerloom.llm.queries import secret_ledger
from ledgerloom.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (null, empty, or without a letter) go; a null language is filled in by the prediction.

    Repeated rows stay or go together, an empty table gives no rows, and other columns, whatever their names, stay as they are.
    """
    found = language.with_language(docs).filter(F.col("lang_pred") != language.UNKNOWN)
    of = lambda c: F.col("row").getField(c)
    return found.select(*((F.coalesce(of(c), "lang_pred") if c == "lang" else of(c)).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the first by id: of repeated rows one, and one of all without a word
    (null, empty or blank). An empty table gives no rows; other columns stay as they are."""
    return neardup.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go, repeated ones together; null and empty texts stay. An empty table gives no
    rows; other columns stay as they are."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it become their kind in brackets, and ``n_chars`` follows the text (null for a null one).
    Repeated rows agree; an empty table gives no rows; other columns stay as they are."""
    clean = secrets.redact(docs, ledger=secret_ledger(spark, sf_dir))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests; a null text is the empty one, without tokens. Repeated rows keep theirs;
    an empty table gives no rows."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark), ("secrets", without_secrets), ("tokens", tokens)]
#: DuckDB has neither XXH64 nor a tokenizer: the tests hold every stage against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
