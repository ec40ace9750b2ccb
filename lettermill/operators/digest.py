"""Markdown digests from summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.flags import collapse_edges
from lettermill.functions.text import capitalize
from lettermill.session import materialize

# Fixed value: the audience when none is given.
DEFAULT_AUDIENCE = "robert"


def digest_item(text: Column, summary: Column | None = None) -> Column:
    """A plain item, or the ``summary`` of a structured one, trimmed; null when nothing is left."""
    value = text if summary is None else F.coalesce(summary, text)
    return F.nullif(collapse_edges(value), F.lit(""))


def digest_audience(audience: Column) -> Column:
    return F.coalesce(F.nullif(collapse_edges(audience), F.lit("")), F.lit(DEFAULT_AUDIENCE))


def digest_header(audience: Column) -> Column:
    return F.concat(F.lit("## Daily Digest for "), capitalize(audience))


def digest_lines(items: DataFrame, order: list[str]) -> DataFrame:
    """A digest as rows: ``(audience, section, *order, line)``.

    Section 0 is the header, 1 the empty line after it, 2 the items by ``order``. ``items`` has ``audience``,
    ``item`` and the order columns. There is no group to collect: the text files come from a range
    partitioned sort by these columns, and one audience may span many of them.
    """
    clean = items.select(digest_audience(F.col("audience")).alias("audience"), *order, digest_item(F.col("item")).alias("item"))
    clean = clean.where(F.col("item").isNotNull())
    body = clean.select("audience", F.lit(2).alias("section"), *order, F.concat(F.lit("- "), "item").alias("line"))
    heads = clean.select("audience").distinct()
    no_order = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in order]
    opening = F.array(
        F.struct(F.lit(0).alias("section"), digest_header(F.col("audience")).alias("line")),
        F.struct(F.lit(1).alias("section"), F.lit("").alias("line")),
    )
    header = heads.select("audience", F.inline(opening)).select("audience", "section", *no_order, "line")
    return header.unionByName(body)


def digest_build(items: DataFrame) -> DataFrame:
    """``(audience, line_no, line)``: the Markdown lines of every audience's digest, numbered from 1.

    ``items`` has ``audience``, ``ord`` (the order of its items) and ``item``. All digests are sorted in ranges, so one audience may
    span many tasks; lines are counted per range and audience, and only these counts are summed in order. Equal or null ``ord`` are
    ordered by the text. Audiences without any item have no digest.
    """
    # Ranges are set by a sample of the lines, so they are written before: making them may be costly.
    written = materialize(digest_lines(items, ["ord"]), "digest-unordered")
    lines = written.repartitionByRange("audience", "section", "ord", "line")
    placed = lines.sortWithinPartitions("audience", "section", "ord", "line").select(
        "audience", "line", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    )
    placed = materialize(placed, "digest-lines")
    counts = placed.groupBy("audience", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("audience").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("audience", "part", (before - F.col("first")).alias("shift")), "digest-starts")
    number = (F.col("place") + F.col("shift") + 1).alias("line_no")
    return placed.join(starts, ["audience", "part"]).select("audience", number, "line")
