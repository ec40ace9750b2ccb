"""Keyed upserts as joins of the stored and the incoming rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.checks import fail_where
from lettermill import schemas

_DOCUMENT_COLUMNS = [c for c in schemas.DOCUMENTS.names if c not in ("document_key", "created_at", "updated_at")]


def _moment(now: datetime | str) -> Column:
    """One literal per run, not one clock reading per row."""
    return F.lit(now).cast("timestamp")


def _union_maps(old: Column, new: Column) -> Column:
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.coalesce(F.map_concat(kept, new), new, old)


def _merge_memberships(old: Column, new: Column) -> Column:
    """The new metadata, with the folders of earlier runs kept."""
    folders = F.array_union(F.coalesce(old["folders"], F.array().cast("array<string>")), new["folders"])
    merged = new.withField("folders", folders)
    for name in ("folder_uids", "folder_flags", "folder_keywords"):
        merged = merged.withField(name, _union_maps(old[name], new[name]))
    return merged


def upsert_documents(
    stored: DataFrame, incoming: DataFrame, now: datetime | str, merge_metadata: bool = False
) -> DataFrame:
    """All rows after the upsert, plus ``inserted``: true/false for incoming keys, null for untouched ones.

    An incoming row replaces every column of the stored one but ``created_at``. With ``merge_metadata`` the
    folder memberships of both are united. Both sides are unique per key, so no key can be hot.
    """
    old, new = stored.alias("old"), incoming.alias("new")
    given, had = F.col("new.document_key").isNotNull(), F.col("old.document_key").isNotNull()

    def value(name: str) -> Column:
        fresh = F.col(f"new.{name}")
        if name == "metadata" and merge_metadata:
            fresh = F.when(had, _merge_memberships(F.col("old.metadata"), fresh)).otherwise(fresh)
        return F.when(given, fresh).otherwise(F.col(f"old.{name}")).alias(name)

    joined = old.join(new, F.col("old.document_key") == F.col("new.document_key"), "full_outer")
    return joined.select(
        F.coalesce("new.document_key", "old.document_key").alias("document_key"),
        *[value(c) for c in _DOCUMENT_COLUMNS],
        F.coalesce("old.created_at", _moment(now)).alias("created_at"),
        F.when(given, _moment(now)).otherwise(F.col("old.updated_at")).alias("updated_at"),
        F.when(given, ~had).alias("inserted"),
    )


def upsert_embeddings(stored: DataFrame, incoming: DataFrame, now: datetime | str) -> DataFrame:
    """All rows after the upsert, plus ``updated``: whether an incoming row was written.

    A stored vector is replaced only if its checksum or dimensions differ (null-safe). Vectors keep eight
    decimals, which is the caller's ``round_vector``.
    """
    key = ["document_key", "provider", "model_name"]
    old, new = stored.alias("old"), incoming.alias("new")
    # The space is no key of the join but a condition on its pairs, of which a document has a few: stored vectors are bucketed by
    # their document, and a join by more columns than that would shuffle them.
    space = lambda side: F.struct(f"{side}.provider", f"{side}.model_name")
    on = (F.col("old.document_key") == F.col("new.document_key")) & F.array_contains(F.array(space("new")), space("old"))
    given, had = F.col("new.document_key").isNotNull(), F.col("old.document_key").isNotNull()
    same = F.col("old.content_checksum").eqNullSafe(F.col("new.content_checksum")) & F.col(
        "old.dimensions"
    ).eqNullSafe(F.col("new.dimensions"))
    write = given & (~had | ~same)
    take = lambda c: F.when(write, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return old.join(new, on, "full_outer").select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in key],
        *[take(c) for c in ("dimensions", "embedding", "content_checksum")],
        F.coalesce("old.created_at", _moment(now)).alias("created_at"),
        F.when(write, _moment(now)).otherwise(F.col("old.updated_at")).alias("updated_at"),
        F.when(given, write).alias("updated"),
    )


def upsert_sync_state(stored: DataFrame, incoming: DataFrame, now: datetime | str) -> DataFrame:
    """Folder cursors, keyed by account, folder and UIDVALIDITY."""
    key = ["imap_user", "imap_host", "imap_folder", "uidvalidity"]
    values = ["last_synced_uid", "last_sync_time", "sync_run_id", "total_emails_in_folder"]
    old, new = stored.alias("old"), incoming.alias("new")
    given = F.col("new.imap_folder").isNotNull()
    return old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full_outer").select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in key],
        *[F.when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in values],
        F.coalesce("old.created_at", _moment(now)).alias("created_at"),
        F.when(given, _moment(now)).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def last_write_wins(observations: DataFrame) -> DataFrame:
    """One observation per (document, run): the one written last by ``(phase, folder_ord)``.

    ``max_by`` instead of a window: it combines on the map side and sorts no group.
    """
    values = ["was_present_in_mailbox", "folder_names", "folder_uids", "last_seen_at"]
    best = observations.groupBy("document_key", "sync_run_id").agg(
        F.max_by(F.struct(*values), F.struct("phase", "folder_ord")).alias("last")
    )
    return best.select("document_key", "sync_run_id", "last.*")


def record_document_sync(stored: DataFrame, observations: DataFrame, now: datetime | str) -> DataFrame:
    """Stored observations upserted with those of a run (or of its replay)."""
    new, old = last_write_wins(observations).alias("new"), stored.alias("old")
    key = ["document_key", "sync_run_id"]
    given = F.col("new.document_key").isNotNull()
    values = ["was_present_in_mailbox", "folder_names", "folder_uids", "last_seen_at"]
    return old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full_outer").select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in key],
        *[F.when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in values],
        F.coalesce("old.created_at", _moment(now)).alias("created_at"),
    )


def unknown_documents(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """Observed keys no document has; must be empty before observations are recorded."""
    return observations.select("document_key").join(documents, "document_key", "left_anti").distinct()


def lookup_documents(keys: DataFrame, documents: DataFrame) -> DataFrame:
    """The document of every key; an unknown key fails the job."""
    found = keys.join(documents.withColumn("_known", F.lit(True)), "document_key", "left")
    message = F.concat(F.lit("unknown document_key "), "document_key")
    return fail_where(found, F.col("_known").isNull(), message).drop("_known")


def remove_folder_membership(documents: DataFrame, missing: DataFrame) -> DataFrame:
    """Take the folders of ``missing`` (document_key, folder) out of the list and the three maps of each document.

    The folders to remove are grouped per document first: at most the folders a document is in.
    """
    gone = missing.groupBy("document_key").agg(F.collect_set("folder").alias("_gone"))
    keep = lambda k, _: ~F.array_contains(F.col("_gone"), k)
    m = F.col("metadata")
    folders = F.filter(m["folders"], lambda f: ~F.array_contains(F.col("_gone"), f))
    cleaned = m.withField("folders", F.coalesce(folders, F.array().cast("array<string>")))
    for name, kind in (
        ("folder_uids", schemas.UID_MAP),
        ("folder_flags", schemas.TERM_MAP),
        ("folder_keywords", schemas.TERM_MAP),
    ):
        cleaned = cleaned.withField(name, F.coalesce(F.map_filter(m[name], keep), F.create_map().cast(kind)))
    joined = documents.join(gone, "document_key", "left")
    return joined.withColumn("metadata", F.when(F.col("_gone").isNull(), m).otherwise(cleaned)).drop("_gone")


def is_orphan() -> Column:
    """An email document that is in no folder."""
    folders = F.coalesce(F.size("metadata.folders"), F.lit(0))
    return (F.col("source_type") == "email") & (folders <= 0)


def purge_orphan_documents(documents: DataFrame) -> DataFrame:
    return documents.where(~is_orphan())


def cascade_delete(children: DataFrame, documents: DataFrame) -> DataFrame:
    """The children whose document still exists."""
    return children.join(documents.select("document_key"), "document_key", "left_semi")


def schema_backfill(old: DataFrame, schema, defaults: dict[str, Column]) -> DataFrame:
    """Old rows in a newer schema: absent or null columns get their default."""
    have = set(old.columns)

    def column(field):
        default = defaults.get(field.name, F.lit(None))
        value = F.coalesce(field.name, default) if field.name in have else default
        return value.cast(field.dataType).alias(field.name)

    return old.select(*[column(f) for f in schema.fields])


def backfill_embeddings(old: DataFrame) -> DataFrame:
    return schema_backfill(old, schemas.EMBEDDINGS, {"provider": F.lit("legacy")})


def backfill_sync_runs(old: DataFrame) -> DataFrame:
    return schema_backfill(old, schemas.SYNC_RUNS, {"folder_uids": F.create_map()})
