"""Embedding operators: feature hashing, a pluggable batch model, fallback, staleness."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import collapse_whitespace, is_blank, word_tokens
from lettermill.functions.vectors import dense_from_sparse
from lettermill.session import materialize

# The hashing defaults.
HASH_PROVIDER = "hashing"
HASH_MODEL = "hashing-v1"
HASH_DIMENSIONS = 256
MIN_HASH_DIMENSIONS = 8
TEXT_REQUIRED = "there is no text to embed"

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]


def _check_dimensions(dimensions: int) -> None:
    if dimensions < MIN_HASH_DIMENSIONS:
        raise ValueError(f"hashing needs at least {MIN_HASH_DIMENSIONS} dimensions")


def hash_cells(texts: DataFrame, key: str, text: str, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """Signed token counts ``(key, bucket, weight)``, plus one row with a null bucket for token-less texts.

    Tokens are hashed before the texts are brought together by key, so what is shuffled per text is one short number for each token, and
    once: the counts by key and bucket, and what is gathered by key from them, need no other shuffle. They take many times the room of
    the codes, so the partitions keep their number and are not merged by the size of the codes.
    """
    _check_dimensions(dimensions)
    # Five digest bytes as one number: the first four, big-endian, give the bucket, the parity of the fifth the sign.
    head = lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 10), 16, 10).cast("long")
    code = lambda h: (F.shiftright(h, 8) % dimensions) * 2 + h % 2
    kind = "smallint" if 2 * dimensions <= 1 << 15 else "bigint"
    heads = F.transform(word_tokens(F.col(text)), head)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = texts.select(key, F.transform(heads, lambda h: code(h).cast(kind)).alias("codes")).repartition(parts, key)
    rows = codes.select(key, F.explode_outer("codes").alias("code"))
    bucket = F.shiftright(F.col("code").cast("bigint"), 1).cast("int")
    signed = rows.select(key, bucket.alias("bucket"), (1 - 2 * (F.col("code").cast("bigint") % 2)).alias("sign"))
    return signed.groupBy(key, "bucket").agg(F.sum("sign").alias("weight"))


def hash_embed(
    texts: DataFrame,
    key: str,
    text: str = "searchable_text",
    dimensions: int = HASH_DIMENSIONS,
    model_name: str = HASH_MODEL,
) -> DataFrame:
    """``(key, vector, dimensions, provider, model_name)``; token-less texts get the zero vector."""
    cells = hash_cells(texts, key, text, dimensions)
    used = F.when(F.col("weight") != 0, F.struct("bucket", F.col("weight").cast("double").alias("weight")))
    rows = cells.groupBy(key).agg(
        F.sort_array(F.collect_list(used)).alias("entries"),  # at most one entry per dimension
        F.sqrt(F.sum(F.col("weight").cast("double") * F.col("weight"))).alias("norm"),
    )
    unit = F.transform("entries", lambda e: F.struct(e["bucket"], (e["weight"] / F.col("norm")).alias("weight")))
    sparse = rows.select(key, unit.alias("entries"))
    return sparse.select(
        key,
        dense_from_sparse(F.col("entries"), dimensions).alias("vector"),
        F.lit(dimensions).alias("dimensions"),
        F.lit(HASH_PROVIDER).alias("provider"),
        F.lit(model_name).alias("model_name"),
    )


def _call(embed_fn: EmbedFn, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """Vector or error per text. A failing or malformed batch is retried text by text, so that one bad
    text does not spoil its neighbours."""
    if not texts:
        return []
    try:
        answer = embed_fn(texts)
        if len(answer) != len(texts):
            raise ValueError("the model did not return one vector per text")
        vectors = []
        for i, raw in enumerate(answer):
            if raw is None or isinstance(raw, (str, bytes)) or len(raw) == 0:
                raise ValueError("empty or malformed vector")
            try:
                vectors.append(([float(v) for v in raw], None))
            except (TypeError, ValueError) as exc:
                raise ValueError(f"vector {i} of the batch is not numeric") from exc
        return vectors
    except Exception as exc:  # noqa: BLE001 - a model may fail in any way; the reason becomes a column
        if len(texts) == 1:
            return [(None, str(exc))]
        return [result for text in texts for result in _call(embed_fn, [text])]


def model_embed(
    texts: DataFrame, key: str | list[str], embed_fn: EmbedFn, provider: str, model_name: str,
    text: str = "searchable_text", batch_size: int = 64,
) -> DataFrame:
    """Batched calls of a user-supplied model inside the tasks.

    ``(key, vector, dimensions, provider, model_name, error)``: each row has a vector or an error. Only the
    key and the collapsed text travel to Python. The plan calls the model anew wherever it is used, so
    store the result if it feeds more than one branch.
    """
    keys = [key] if isinstance(key, str) else list(key)
    source = texts.select(*keys, collapse_whitespace(F.coalesce(text, F.lit(""))).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                answers = iter(_call(embed_fn, [t for t in part["_text"] if t]))
                rows = [next(answers) if t else (None, TEXT_REQUIRED) for t in part["_text"]]
                yield part[keys].assign(vector=[v for v, _ in rows], error=[e for _, e in rows])

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    answered = source.mapInPandas(run, f"{kinds}, vector array<double>, error string")
    return answered.select(
        *keys,
        "vector",
        F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimensions"),
        F.lit(provider).alias("provider"),
        F.lit(model_name).alias("model_name"),
        "error",
    )


def embed_with_fallback(
    texts: DataFrame, key: str, primary: DataFrame, text: str = "searchable_text", dimensions: int = HASH_DIMENSIONS
) -> DataFrame:
    """Hash-embed the texts whose ``primary`` row carries an error.

    ``primary`` is written once before it is split, so the model runs once per text.
    Adds ``used_fallback`` and ``fallback_reason``. A blank text, which hashing refuses as well, keeps its row and its reason, without a vector.
    """
    stored = materialize(primary, "primary-embeddings")
    good = stored.where(F.col("error").isNull()).drop("error")
    # Inside a struct a null key equals itself, as it does where texts are grouped by key.
    held = F.struct(key).alias("_key")
    failed = stored.where(F.col("error").isNotNull()).select(held, F.col("error").alias("fallback_reason"))
    pending = texts.where(~is_blank(F.col(text))).select(held, text).join(failed, "_key", "left_semi")
    rescued = failed.join(hash_embed(pending, "_key", text, dimensions), "_key", "left").select(
        F.col("_key")[key].alias(key),
        "vector",
        "dimensions",
        F.lit(HASH_PROVIDER).alias("provider"),
        F.lit(HASH_MODEL).alias("model_name"),
        "fallback_reason",
    )
    return good.select(
        "*", F.lit(False).alias("used_fallback"), F.lit(None).cast("string").alias("fallback_reason")
    ).unionByName(rescued.withColumn("used_fallback", F.lit(True)))


def stale_documents(
    documents: DataFrame, embeddings: DataFrame, provider: str, model_name: str, dimensions: int | None
) -> DataFrame:
    """Documents with no current vector in this provider/model space; only these need embedding.

    Without ``dimensions`` (a model whose size is not known beforehand) only the checksum decides.
    """
    space = embeddings.where((F.col("provider") == provider) & (F.col("model_name") == model_name))
    if dimensions is not None:
        space = space.where(F.col("dimensions") == dimensions)
    return documents.join(space.select("document_key", "content_checksum"), ["document_key", "content_checksum"], "left_anti")
