"""Token counts with a digest cache: only distinct texts that the cache does not know are encoded, and appended to it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.bytes_of import short_batches
from lettermill.llm.codec import codec
from lettermill.session import materialize

CACHE = "version string, digest binary, n_tokens bigint"


def content_digest(text: Column) -> Column:
    """SHA-256 of the content. Normalising must not change tokens, so it only makes null empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # noqa: SLF001


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``cache`` is a table folder that all executors reach; it is made if it is missing, and rows of other tokenizer versions stay.
    ``tokenizer`` is a file that is in the same place on every machine. Only digests that the cache lacks for this version are
    encoded, each once, and appended as a new part. If two runs append the same digest, either row counts.

    Null texts count as empty, with no tokens and no bytes. Repeated rows are counted one by one, from one encoding. Very long texts
    are encoded whole. Empty tables give no rows. Ids may be null or repeated; other columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    short_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    missing = own.select(content_digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    if _exists(docs, cache):
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest")
        missing = missing.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(tokenizer)
        for batch in batches:
            counts = [np.diff(begin) for _, _, begin in use.encode(batch.column("text"))]
            found = pa.array(np.concatenate(counts) if counts else [], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), found], names=["digest", "n_tokens"])

    fresh = missing.dropDuplicates(["digest"]).mapInArrow(encode, "digest binary, n_tokens bigint")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    counts = materialize(counts.groupBy(F.col("digest").alias("known_digest")).agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    keyed = own.select(
        "doc_id", content_digest(F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")
    )
    return keyed.join(counts, F.col("digest") == F.col("known_digest")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
