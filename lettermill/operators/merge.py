"""Collapse copies of one message into one row with the provenance of all folders."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.checks import fail_where
from lettermill import schemas

_FIRST_WINS = ("source_message_id", "subject", "sender", "recipients", "raw_date", "sent_at", "sent_at_iso", "content_checksum")
_LONG = ("body", "searchable_text", "headers")


class Merged(NamedTuple):
    ok: DataFrame
    conflicts: DataFrame


def _heads(normalized: DataFrame) -> DataFrame:
    """The earliest copy per fingerprint. ``min_by`` combines on the map side, so a fingerprint with very
    many copies sends one row per map task. Texts are picked apart from the short columns: who reads none of them, as reports do, has
    no text in the aggregation and its shuffle."""
    return normalized.groupBy("fingerprint").agg(
        F.min_by(F.struct(*_FIRST_WINS), "seq").alias("head"),
        F.min_by(F.struct(*_LONG), "seq").alias("texts"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("copies"),
        (F.min("content_checksum") != F.max("content_checksum")).alias("checksum_conflict"),
    )


def folder_memberships(normalized: DataFrame) -> DataFrame:
    """One row per (fingerprint, folder): first sight, UID, the last non-empty flags and keywords."""
    folder = F.col("folders")[0]
    return (
        normalized.where(F.size("folders") > 0)
        .select(
            "fingerprint",
            "seq",
            folder.alias("folder"),
            F.try_element_at("folder_uids", folder).alias("uid"),
            F.try_element_at("folder_flags", folder).alias("flags"),
            F.try_element_at("folder_keywords", folder).alias("keywords"),
        )
        .groupBy("fingerprint", "folder")
        .agg(
            F.min("seq").alias("first_seq"),
            F.min("uid").alias("uid"),
            (F.min("uid") != F.max("uid")).alias("uid_conflict"),
            F.max_by("flags", F.when(F.col("flags").isNotNull(), F.col("seq"))).alias("flags"),
            F.max_by("keywords", F.when(F.col("keywords").isNotNull(), F.col("seq"))).alias("keywords"),
        )
    )


def _folder_columns(memberships: DataFrame) -> DataFrame:
    """Fold the memberships of a fingerprint into arrays and maps. A group holds one entry per distinct
    folder, so its size is bounded by the folder count of the mailbox, not by the number of copies."""
    grouped = memberships.groupBy("fingerprint").agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "folder", "uid", "flags", "keywords"))).alias("entries"),
        F.coalesce(F.max("uid_conflict"), F.lit(False)).alias("uid_conflict"),
    )

    def as_map(field: str):
        kept = F.filter("entries", lambda e: e[field].isNotNull())
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["folder"], e[field])))

    return grouped.select(
        "fingerprint",
        F.transform("entries", lambda e: e["folder"]).alias("folders"),
        as_map("uid").alias("folder_uids"),
        as_map("flags").alias("folder_flags"),
        as_map("keywords").alias("folder_keywords"),
        "uid_conflict",
    )


def merged_rows(normalized: DataFrame) -> DataFrame:
    """All fingerprints, with ``conflict`` naming the reason why a group cannot be merged (null if it can).

    Two narrow-or-head aggregations joined on the fingerprint both are partitioned by, instead of one
    ``collect_list`` of whole copies: bodies are shuffled once, and only one per map task and fingerprint.
    ``normalized`` should be a stored table, so that the folder branch reads its few columns only.
    """
    heads, folders = _heads(normalized), _folder_columns(folder_memberships(normalized))
    joined = heads.join(folders, "fingerprint", "left")
    conflict = F.when(F.col("checksum_conflict"), F.lit("different content")).when(
        F.col("uid_conflict"), F.lit("two UIDs in one folder")
    )
    return joined.select(
        "fingerprint",
        "first_seq",
        "copies",
        "head.*",
        "texts.*",
        F.coalesce("folders", F.array().cast("array<string>")).alias("folders"),
        *[
            F.coalesce(name, F.create_map().cast(kind)).alias(name)
            for name, kind in (
                ("folder_uids", schemas.UID_MAP),
                ("folder_flags", schemas.TERM_MAP),
                ("folder_keywords", schemas.TERM_MAP),
            )
        ],
        conflict.alias("conflict"),
    )


def merge_duplicates(normalized: DataFrame, on_conflict: str = "raise") -> Merged:
    """One row per fingerprint.

    Scalars come from the first message by ``seq``; folders are the ordered union; per folder the last
    non-empty flags and keywords win. Conflicting copies fail the job, or with ``on_conflict="report"``
    are kept out of ``ok`` and listed in ``conflicts``.
    """
    rows = merged_rows(normalized)
    conflict = F.col("conflict")
    conflicts = rows.where(conflict.isNotNull()).select("fingerprint", "conflict", "copies")
    if on_conflict == "report":
        return Merged(rows.where(conflict.isNull()).drop("conflict"), conflicts)
    message = F.concat(F.lit("copies of message "), "fingerprint", F.lit(" cannot be merged: "), conflict)
    return Merged(fail_where(rows, conflict.isNotNull(), message).drop("conflict"), conflicts)


def dedup_ratio(normalized: DataFrame) -> DataFrame:
    """Messages against distinct fingerprints: pre-aggregated per fingerprint, then one tiny final sum."""
    per_key = normalized.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count(F.lit(1)).alias("documents"),
    )
