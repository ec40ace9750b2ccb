"""The four flag and keyword reports over stored documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.flags import is_system_flag
from lettermill.operators.normalize import message_ref

ALL_FOLDERS = "ALL_FOLDERS"
_NO_TERMS = "map<string,array<string>>"


def _emails(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("source_type") == "email")


def _maps(flags: Column, keywords: Column) -> Column:
    return F.array(
        F.struct(F.lit("flag").alias("term_type"), F.coalesce(flags, F.create_map().cast(_NO_TERMS)).alias("by_folder")),
        F.struct(F.lit("keyword").alias("term_type"), F.coalesce(keywords, F.create_map().cast(_NO_TERMS)).alias("by_folder")),
    )


def term_pairs(documents: DataFrame) -> DataFrame:
    """Every term occurrence: flags and keywords from one scan instead of a union of two."""
    maps = _maps(F.col("metadata.folder_flags"), F.col("metadata.folder_keywords"))
    typed = _emails(documents).select(
        "document_key", message_ref().alias("message_ref"), F.col("metadata.sent_at").alias("sent_at"), F.inline(maps)
    )
    by_folder = typed.select(
        "document_key", "message_ref", "sent_at", "term_type", F.explode("by_folder").alias("folder_name", "terms")
    )
    return by_folder.select(
        "document_key", "message_ref", "sent_at", "term_type", "folder_name", F.explode("terms").alias("term")
    )


def _occurrences(terms: Column) -> Column:
    """``array<struct<term, n>>``: distinct terms with their count. A message has few distinct terms."""
    return F.transform(
        F.array_distinct(terms),
        lambda t: F.struct(t.alias("term"), (F.size(terms) - F.size(F.array_remove(terms, t))).alias("n")),
    )


def _entries(by_folder: Column) -> Column:
    """One entry per folder of a document, and one for all its folders together."""
    per_folder = F.transform(
        F.map_entries(by_folder),
        lambda e: F.struct(
            e["key"].alias("folder_name"), F.lit(False).alias("all_folders"), _occurrences(e["value"]).alias("terms")
        ),
    )
    everything = F.flatten(F.map_values(by_folder))
    total = F.array(
        F.struct(
            F.lit(ALL_FOLDERS).alias("folder_name"),
            F.lit(True).alias("all_folders"),
            _occurrences(everything).alias("terms"),
        )
    )
    return F.concat(per_folder, total)


def _term_rows(documents: DataFrame, maps: Column) -> DataFrame:
    """Per document one row for each (type, folder or all folders, distinct term).

    A document key is unique, so counting documents needs no distinct aggregation after this.
    """
    typed = documents.select(
        message_ref().alias("message_ref"), F.col("metadata.sent_at").alias("sent_at"), F.inline(maps)
    )
    folders = typed.select("message_ref", "sent_at", "term_type", F.inline(_entries(F.col("by_folder"))))
    return folders.select("message_ref", "sent_at", "term_type", "folder_name", "all_folders", F.inline("terms"))


def _counts(rows: DataFrame, group: list[str]) -> DataFrame:
    """Occurrences, documents and distinct message references per group and per group over all folders.

    Two steps: first per reference, which spreads a term that is on nearly every message over all tasks,
    then per group from map-side partial sums. The built-in form, grouping sets with two distinct counts,
    would multiply the rows by six before the first shuffle.
    """
    by_ref = rows.groupBy(*group, "all_folders", "message_ref").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("documents"),
        F.min("sent_at").alias("first_sent"),
        F.max("sent_at").alias("last_sent"),
    )
    return by_ref.groupBy(*group, "all_folders").agg(
        F.sum("n").cast("long").alias("occurrences"),
        F.sum("documents").alias("message_count"),
        F.count(F.lit(1)).alias("unique_message_refs"),
        F.min("first_sent").alias("first_seen_sent_at"),
        F.max("last_sent").alias("last_seen_sent_at"),
    )


def report_flags_detail(documents: DataFrame) -> DataFrame:
    """One row per document and folder with its flags and keywords, newest first.

    The folder names are the union of the keys of both maps; a lookup replaces the two lateral joins.
    """
    flags = F.coalesce("metadata.folder_flags", F.create_map().cast(_NO_TERMS))
    keywords = F.coalesce("metadata.folder_keywords", F.create_map().cast(_NO_TERMS))
    rows = _emails(documents).select(
        F.col("document_key").alias("document_id"),
        message_ref().alias("message_ref"),
        "title",
        F.col("metadata.sender").alias("sender"),
        F.col("metadata.sent_at").alias("sent_at"),
        flags.alias("f"),
        keywords.alias("k"),
    )
    folders = rows.withColumn("folder_name", F.explode(F.array_union(F.map_keys("f"), F.map_keys("k"))))
    terms = lambda m: F.coalesce(F.try_element_at(m, F.col("folder_name")), F.array().cast("array<string>"))
    detail = folders.withColumns({"flags": terms(F.col("f")), "keywords": terms(F.col("k"))}).drop("f", "k")
    return detail.orderBy(F.col("sent_at").desc_nulls_last(), "message_ref", "folder_name")


def report_terms_summary(documents: DataFrame) -> DataFrame:
    maps = _maps(F.col("metadata.folder_flags"), F.col("metadata.folder_keywords"))
    counts = _counts(_term_rows(_emails(documents), maps), ["term_type", "folder_name", "term"])
    return counts.select(
        "term_type",
        "folder_name",
        "term",
        F.col("occurrences").alias("term_occurrences"),
        "message_count",
        "unique_message_refs",
    ).orderBy("term_type", "folder_name", F.desc("message_count"), "term")


def report_terms_summary_filtered(
    documents: DataFrame,
    start_at: datetime | str | None = None,
    end_at: datetime | str | None = None,
    folder_name: str | None = None,
) -> DataFrame:
    """The summary for messages sent in ``[start_at, end_at)`` and one folder. An absent bound adds no
    predicate at all; with a bound, messages without a date drop out."""
    emails = _emails(documents)
    sent_at = F.col("metadata.sent_at")
    if start_at is not None:
        emails = emails.where(sent_at >= F.lit(start_at).cast("timestamp"))
    if end_at is not None:
        emails = emails.where(sent_at < F.lit(end_at).cast("timestamp"))
    flags, keywords = F.col("metadata.folder_flags"), F.col("metadata.folder_keywords")
    if folder_name is not None:
        one_folder = lambda m: F.map_filter(m, lambda k, _: k == folder_name)
        flags, keywords = one_folder(flags), one_folder(keywords)
    counts = _counts(_term_rows(emails, _maps(flags, keywords)), ["term_type", "folder_name", "term"])
    return counts.select(
        "term_type",
        "folder_name",
        "term",
        F.col("occurrences").alias("term_occurrences"),
        "message_count",
        "unique_message_refs",
        "first_seen_sent_at",
        "last_seen_sent_at",
    ).orderBy("term_type", "folder_name", F.desc("message_count"), "term")


def report_system_flags(documents: DataFrame) -> DataFrame:
    """Counts of the flags with a leading backslash; others are dropped inside the row."""
    flags = F.coalesce("metadata.folder_flags", F.create_map().cast(_NO_TERMS))
    system = F.transform_values(flags, lambda _, terms: F.filter(terms, is_system_flag))
    maps = F.array(F.struct(F.lit("flag").alias("term_type"), system.alias("by_folder")))
    counts = _counts(_term_rows(_emails(documents), maps), ["folder_name", "term"])
    return counts.select(
        "folder_name",
        F.col("term").alias("flag_name"),
        F.col("occurrences").alias("flag_occurrences"),
        "message_count",
        "unique_message_refs",
    ).orderBy("folder_name", F.desc("message_count"), "flag_name")
