"""Continuous ingest: every micro-batch goes through the batch job's persisting half."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.operators.sync import latest_sync_state
from lettermill.plans.ingest import Account, HashEmbedder, persist_messages
from lettermill.session import drop_folder, fresh_dir, materialize
from lettermill.sinks.store import Store


def ingest_batch(
    store: Store, batch: DataFrame, *, account: Account, run_id: str, observed_at: datetime | str,
    uidvalidity: int, embedder=HashEmbedder(),
) -> None:
    """Store one batch of new messages and move the folders' cursors on.

    Memberships are united with those of earlier batches, because the copies of a message may arrive in
    different ones. A stream says nothing about vanished messages, so nothing is reconciled.
    """
    store.bootstrap()
    scratch = fresh_dir(store.spark, "stream-batch")
    batch = materialize(batch, "messages", scratch)
    seen = batch.where(F.col("folder").isNotNull()).groupBy("folder").agg(
        F.max("imap_uid").alias("batch_uid"), F.count(F.lit(1)).alias("batch_count")
    )
    mine = (F.col("imap_user") == account.user) & (F.col("imap_host") == account.host)
    states = store.read("mailbox_sync_state").where(mine & (F.col("uidvalidity") == uidvalidity))
    latest = latest_sync_state(states).select(
        F.col("imap_folder").alias("folder"), "last_synced_uid", "total_emails_in_folder", "sync_run_id"
    )
    # A replayed batch has been counted before.
    fresh = F.when(F.col("sync_run_id") == run_id, 0).otherwise(F.col("batch_count"))
    cursors = seen.join(latest, "folder", "left").select(
        "folder",
        F.lit(uidvalidity).cast("long").alias("uidvalidity"),
        F.greatest("batch_uid", "last_synced_uid").alias("last_synced_uid"),
        (F.coalesce("total_emails_in_folder", F.lit(0)) + fresh).cast("long").alias("message_count"),
    )
    plan = cursors.select(
        "folder", F.lit("incremental").alias("sync_mode"), "message_count", "uidvalidity",
        (F.col("last_synced_uid") + 1).alias("uidnext"),
    )
    persist_messages(
        store, batch, plan=plan, cursors=cursors, server_uids=None, account=account, run_id=run_id,
        observed_at=observed_at, embedder=embedder, merge_metadata=True,
    )
    drop_folder(store.spark, scratch)


def stream_ingest(
    store: Store,
    messages: DataFrame,
    checkpoint: str,
    *,
    account: Account,
    stream_name: str,
    observed_at: Callable[[], datetime | str],
    uidvalidity: int = 1,
    embedder=HashEmbedder(),
) -> StreamingQuery:
    """Take in what is there and stop; start it again to resume after the last committed batch.

    ``foreachBatch`` may replay a batch. The run id comes from the batch id and every write is a keyed upsert,
    so a replay leaves the same tables.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(
            store, batch, account=account, run_id=f"{stream_name}-{batch_id}", observed_at=observed_at(),
            uidvalidity=uidvalidity, embedder=embedder,
        )

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
