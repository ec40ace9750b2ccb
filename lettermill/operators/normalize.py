"""Messages to canonical rows, canonical rows to documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.functions.checks import fail_where
from lettermill import schemas
from lettermill.functions.dates import common_date_fields, iso_to_timestamp, library_iso, parse_common_date, sent_at_iso
from lettermill.functions.flags import build_recipients
from lettermill.functions.text import blank_to_null, collapse_whitespace, is_blank, sha256_hex

BLANK_MESSAGE = "message has neither subject nor body"


class Normalized(NamedTuple):
    ok: DataFrame
    rejected: DataFrame


def _empty_map(kind: T.MapType) -> Column:
    return F.create_map().cast(kind)


def _folder_map(folder: Column, value: Column, keep: Column, kind: T.MapType) -> Column:
    return F.when((folder != "") & keep, F.create_map(folder, value)).otherwise(_empty_map(kind))


def canonical_rows(messages: DataFrame, rare_dates: bool = True) -> DataFrame:
    """One canonical row per message, blank ones included. Narrow: no shuffle.

    ``messages`` has an orderable ``seq`` column plus any of the columns of ``schemas.MESSAGE``; absent
    ones count as null. With ``rare_dates=False`` unusual date headers stay null and no Python runs.
    """
    have = set(messages.columns)
    raw = messages.select(
        "seq",
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.MESSAGE.fields
        ],
    )
    text = lambda name: collapse_whitespace(F.coalesce(F.col(name), F.lit("")))
    cleaned = raw.select(
        "seq",
        text("message_id").alias("message_id"),
        text("subject").alias("subject"),
        text("sender").alias("sender"),
        build_recipients(F.col("to"), F.col("cc"), F.col("bcc"), F.col("reply_to")).alias("recipients"),
        F.coalesce("date_raw", F.lit("")).alias("raw_date"),
        common_date_fields(F.coalesce("date_raw", F.lit(""))).alias("date_fields"),
        text("folder").alias("folder"),
        text("body").alias("body"),
        F.coalesce("headers", _empty_map(schemas.HEADER_MAP)).alias("headers"),
        "imap_uid",
        "imap_flags",
        "imap_keywords",
    )
    dated = cleaned.withColumn("parsed_date", parse_common_date(F.col("date_fields")))
    joined = dated.select(
        "*",
        blank_to_null(F.col("message_id")).alias("source_message_id"),
        F.concat_ws("\n\n", blank_to_null(F.col("subject")), blank_to_null(F.col("body"))).alias("searchable_text"),
        sent_at_iso(F.col("raw_date"), F.col("parsed_date"), rare_dates).alias("sent_at_iso"),
    )
    identity = F.coalesce(
        "source_message_id",
        F.concat_ws("|", "sender", collapse_whitespace(F.col("raw_date")), "subject", "searchable_text"),
    )
    folder, flags, keywords = F.col("folder"), F.col("imap_flags"), F.col("imap_keywords")
    filled = lambda values: F.coalesce(F.size(values), F.lit(0)) > 0
    return joined.select(
        "seq",
        sha256_hex(identity).alias("fingerprint"),
        "source_message_id",
        "subject",
        "sender",
        "recipients",
        "raw_date",
        iso_to_timestamp(F.col("sent_at_iso")).alias("sent_at"),
        "sent_at_iso",
        F.when(folder != "", F.array(folder)).otherwise(F.array().cast("array<string>")).alias("folders"),
        _folder_map(folder, F.col("imap_uid"), F.col("imap_uid").isNotNull(), schemas.UID_MAP).alias("folder_uids"),
        _folder_map(folder, flags, filled(flags), schemas.TERM_MAP).alias("folder_flags"),
        _folder_map(folder, keywords, filled(keywords), schemas.TERM_MAP).alias("folder_keywords"),
        "body",
        "searchable_text",
        sha256_hex(F.col("searchable_text")).alias("content_checksum"),
        "headers",
    )


def normalize_messages(messages: DataFrame, strict: bool = False, rare_dates: bool = True) -> Normalized:
    """Canonical rows, and apart from them the messages without any text.

    With ``strict`` a message without text fails the job instead.
    """
    # The test reads the raw text: on the canonical text the pushed-down filter would collapse it twice.
    blank = is_blank(F.col("subject")) & is_blank(F.col("body"))
    reason = F.lit(BLANK_MESSAGE)
    rejected = canonical_rows(messages.where(blank), rare_dates=False).select("seq", "fingerprint", reason.alias("reason"))
    if strict:
        return Normalized(canonical_rows(fail_where(messages, blank, reason), rare_dates), rejected)
    return Normalized(canonical_rows(messages.where(~blank), rare_dates), rejected)


def repair_rare_dates(rows: DataFrame) -> DataFrame:
    """Parse the date headers that ``rare_dates=False`` left open, with the standard library's parser."""
    open_header = F.when(F.col("sent_at_iso").isNull() & (F.col("raw_date") != ""), F.col("raw_date"))
    iso = F.coalesce("sent_at_iso", library_iso(open_header))
    return rows.withColumn("sent_at_iso", iso).withColumn("sent_at", iso_to_timestamp(F.col("sent_at_iso")))


def has_rare_dates(rows: DataFrame) -> bool:
    """Whether any header is left that could be a date; one without a digit cannot. Stops at the first one."""
    return not rows.where(F.col("sent_at_iso").isNull() & F.col("raw_date").rlike("[0-9]")).select("seq").isEmpty()


def to_document(merged: DataFrame) -> DataFrame:
    """Merged mail rows to document rows without timestamps."""
    metadata = F.struct(
        "sender",
        "recipients",
        "raw_date",
        "sent_at",
        "sent_at_iso",
        F.try_element_at("folders", F.lit(1)).alias("folder"),
        "folders",
        "folder_uids",
        "folder_flags",
        "folder_keywords",
        "headers",
    )
    return merged.select(
        F.col("fingerprint").alias("document_key"),
        F.lit("email").alias("source_type"),
        F.col("source_message_id").alias("source_id"),
        F.col("subject").alias("title"),
        "body",
        "searchable_text",
        "content_checksum",
        metadata.alias("metadata"),
    )


def message_ref() -> Column:
    return F.coalesce("source_id", "document_key")
