"""Per-folder cursors: what to fetch, what has vanished."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.sources.mailbox import lookback_start

# Plans up to this many folders become literal predicates, up to the second bound a broadcast join.
LITERAL_FOLDERS = 200
BROADCAST_FOLDERS = 100_000


def latest_sync_state(states: DataFrame) -> DataFrame:
    """The newest cursor per account and folder. ``max_by`` combines on the map side, so long histories of
    one folder do not gather in one task."""
    key = ["imap_user", "imap_host", "imap_folder"]
    values = ["uidvalidity", "last_synced_uid", "last_sync_time", "sync_run_id", "total_emails_in_folder"]
    newest = F.max_by(F.struct(*values), F.struct("last_sync_time", "uidvalidity"))
    return states.groupBy(*key).agg(newest.alias("s")).select(*key, "s.*")


def cursor_join(status: DataFrame, latest: DataFrame, incremental: bool = True) -> DataFrame:
    """The fetch plan: per folder the mode and, for an incremental one, the closed UID range (null: nothing new).

    ``status`` is one row per requested folder, ``latest`` the cursors of one account.
    """
    cursors = latest.select(
        F.col("imap_folder").alias("folder"), F.col("uidvalidity").alias("stored_uidvalidity"), "last_synced_uid"
    )
    valid = (F.col("stored_uidvalidity") == F.col("uidvalidity")) & F.col("last_synced_uid").isNotNull()
    valid = F.coalesce(valid, F.lit(False)) & F.lit(incremental)
    has_new = valid & F.coalesce(F.col("last_synced_uid") + 1 < F.col("uidnext"), F.lit(False))
    return status.join(cursors, "folder", "left").select(
        *status.columns,
        "last_synced_uid",
        F.when(valid, "incremental").otherwise("full").alias("sync_mode"),
        F.when(has_new, F.col("last_synced_uid") + 1).alias("start_uid"),
        F.when(has_new, F.col("uidnext") - 1).alias("end_uid"),
    )


def _in_plan(since: Column) -> Column:
    in_range = F.col("imap_uid").between(F.col("start_uid"), F.col("end_uid"))
    return F.when(F.col("sync_mode") == "full", F.col("received_date") >= since).otherwise(in_range)


def range_fetch(messages: DataFrame, plan: DataFrame, days: int, today: date | str) -> DataFrame:
    """The messages a plan asks for, with ``sync_mode`` and an arrival order by (folder, UID).

    A plan has one row per requested folder. Its first rows are looked at: a usual, short plan is turned
    into literal predicates, so that folder partitions and UID ranges are pruned in the scan; a longer one
    is broadcast once its length is known to be bounded; beyond that it is an ordinary join, where AQE
    splits the partitions of a folder that holds most of the messages. A full scan yields no UIDs.
    """
    since = lookback_start(days, today)
    columns = ["folder", "folder_ord", "sync_mode", "start_uid", "end_uid"]
    narrow = plan.select(*columns)
    rows = narrow.limit(LITERAL_FOLDERS + 1).collect()
    if len(rows) <= LITERAL_FOLDERS:
        predicates = [
            (F.col("folder") == r.folder)
            & (
                (F.col("received_date") >= since)
                if r.sync_mode == "full"
                else F.col("imap_uid").between(r.start_uid, r.end_uid)
            )
            for r in rows
            if r.sync_mode == "full" or r.start_uid is not None
        ]
        messages = messages.where(reduce(lambda a, b: a | b, predicates, F.lit(False)))
        narrow = F.broadcast(messages.sparkSession.createDataFrame(rows, narrow.schema))
    elif narrow.limit(BROADCAST_FOLDERS + 1).count() <= BROADCAST_FOLDERS:
        narrow = F.broadcast(narrow)
    fetched = messages.join(narrow, "folder").where(_in_plan(since))
    uid = F.when(F.col("sync_mode") == "incremental", F.col("imap_uid"))
    arrival = F.struct(F.col("folder_ord"), F.col("seq").alias("pos"))
    return fetched.withColumns({"seq": arrival, "imap_uid": uid}).drop("folder_ord", "start_uid", "end_uid")


def current_folder_uids(documents: DataFrame, folders: Sequence[str] | None = None) -> DataFrame:
    """``(document_key, folder, uid)`` of the stored memberships; only this one map of the metadata is read."""
    uids = F.col("metadata.folder_uids")
    if folders is not None:
        wanted = F.array(*[F.lit(f) for f in folders])
        documents = documents.where(F.arrays_overlap(F.map_keys(uids), wanted))
        uids = F.map_filter(uids, lambda k, _: F.array_contains(wanted, k))
    pairs = documents.select("document_key", F.explode(uids).alias("folder", "uid"))
    return pairs.where(F.col("uid").isNotNull())


def reconcile_missing(memberships: DataFrame, server_uids: DataFrame, plan: DataFrame) -> DataFrame:
    """Stored memberships whose UID the server no longer has: ``(document_key, folder, folder_ord, uid)``.

    A folder that was fully scanned and reports no UIDVALIDITY is left out. The anti join is keyed by folder
    and UID, so a folder that holds most messages still spreads over all tasks.
    """
    checked = plan.where((F.col("sync_mode") == "incremental") | (F.col("uidvalidity") != 0))
    missing = memberships.join(server_uids.select("folder", "uid"), ["folder", "uid"], "left_anti")
    return missing.join(checked.select("folder", "folder_ord"), "folder").select(
        "document_key", "folder", "folder_ord", "uid"
    )


def present_observations(documents: DataFrame, run_id: str, seen_at: Column) -> DataFrame:
    return documents.select(
        "document_key",
        F.lit(run_id).alias("sync_run_id"),
        F.lit(True).alias("was_present_in_mailbox"),
        F.col("metadata.folders").alias("folder_names"),
        F.col("metadata.folder_uids").alias("folder_uids"),
        seen_at.alias("last_seen_at"),
        F.lit(0).alias("phase"),
        F.lit(0).alias("folder_ord"),
    )


def missing_observations(missing: DataFrame, run_id: str, seen_at: Column) -> DataFrame:
    return missing.select(
        "document_key",
        F.lit(run_id).alias("sync_run_id"),
        F.lit(False).alias("was_present_in_mailbox"),
        F.array("folder").alias("folder_names"),
        F.create_map("folder", "uid").alias("folder_uids"),
        seen_at.alias("last_seen_at"),
        F.lit(1).alias("phase"),
        "folder_ord",
    )
