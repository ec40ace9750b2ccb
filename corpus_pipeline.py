"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one.

All stages but the last return the columns of ``documents``. Each works on all that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import decontamination, lang_id, near_text, packing, pii
from lettermill.llm.queries import END_ID, PII_KEY, WINDOW, tokenizer_path
from lettermill.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go: those without a letter, and those far from every language. Learns as op2 does.

    Where no row has a label and a letter nothing can be learned, and only texts without a letter go.
    """
    model = lang_id.train_on_rest(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return lang_id.predict(rows, model).where(~F.col("rejected")).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Candidates are the components of op6's operator and texts that share a sample; links are pairs with a similarity of 0.8 on five-word shingles.
    """
    return near_text.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; ``n_chars`` follows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    replaced = pii.replace_pii(rows, PII_KEY)
    sized = F.when(F.col("pii_count") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    own = {"text": F.col("text"), "n_chars": sized}
    return replaced.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, as op5 returns them."""
    return packing.pack_documents(docs, tokenizer_path(), window=WINDOW, end_id=END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near-duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal-data", without_personal_data),
    ("packing", packed),
]

#: A classifier's answers are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
