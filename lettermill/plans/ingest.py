"""Mailbox ingest: fetch plan, normalise, merge, embed, upsert, observe, reconcile, purge, one commit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lettermill.functions.vectors import round_vector
from lettermill.functions.checks import fail_where
from lettermill.operators import chunks as C
from lettermill.operators import embed as E
from lettermill.operators import sync as S
from lettermill.operators.merge import merge_duplicates
from lettermill.operators.normalize import has_rare_dates, normalize_messages, repair_rare_dates, to_document
from lettermill.schemas import DOCUMENTS
from lettermill.session import drop_folder, fresh_dir, materialize
from lettermill.sinks import memberships as M
from lettermill.sinks import texts as X
from lettermill.sinks import upserts as U
from lettermill.sinks.store import Store
from lettermill.sources.mailbox import folder_selection, normalize_folders


# Batches beyond this many documents are not expected to be broadcast by their keys.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Account:
    user: str
    host: str = "imap.example.com"


@dataclass(frozen=True)
class HashEmbedder:
    """Feature hashing, inside the JVM."""

    dimensions: int = E.HASH_DIMENSIONS
    model_name: str = E.HASH_MODEL
    provider: str = E.HASH_PROVIDER

    def __call__(self, documents: DataFrame) -> DataFrame:
        return E.hash_embed(documents, "document_key", "searchable_text", self.dimensions, self.model_name)


@dataclass(frozen=True)
class ModelEmbedder:
    """A user-supplied batch model, optionally rescued by feature hashing.

    Texts that the model finds too long are halved and pooled; the fallback is for what fails nevertheless.
    """

    embed_fn: E.EmbedFn
    provider: str
    model_name: str
    dimensions: int | None = None
    fallback: bool = False

    def __call__(self, documents: DataFrame) -> DataFrame:
        answered = C.embed_long_texts(documents, "document_key", self.embed_fn, self.provider, self.model_name)
        answered = answered.drop("chunk_count", "chunk_lengths")
        if self.fallback:
            rescued = E.embed_with_fallback(documents, "document_key", answered)
            return fail_where(rescued, F.col("vector").isNull(), F.col("fallback_reason"))
        return fail_where(answered, F.col("error").isNotNull(), F.col("error")).drop("error")


@dataclass(frozen=True)
class IngestReport:
    """Counts of the run; per folder mode and state; per document what happened to it."""

    totals: dict[str, int]
    folders: DataFrame
    persisted: DataFrame
    version: int | None

    def totals_frame(self) -> DataFrame:
        spark = self.folders.sparkSession
        return spark.createDataFrame([tuple(self.totals.values())], ", ".join(f"{k} long" for k in self.totals))


def run_counters(persisted: DataFrame) -> DataFrame:
    """``fetched / inserted / embedding_updates / skipped`` of a run's documents."""
    return persisted.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("inserted").alias("inserted"),
        F.count_if("embedding_updated").alias("embedding_updates"),
        F.count_if("skipped").alias("skipped"),
    )


def fetch_plan(
    store: Store, folder_state: DataFrame, account: Account, folders: Sequence[str], incremental: bool = True
) -> DataFrame:
    """One row per requested folder: server state, cursor and mode."""
    asked = F.broadcast(folder_selection(store.spark, folders))
    state = folder_state.select("folder", "message_count", "uidvalidity", "uidnext")
    # The state side has a row per folder of the mailbox, the asked side one per argument.
    status = state.join(asked, "folder")
    absent = asked.join(state.select("folder"), "folder", "left_anti")
    status = status.unionByName(absent, allowMissingColumns=True).withColumns(
        {
            "message_count": F.coalesce("message_count", F.lit(0)).cast("long"),
            "uidvalidity": F.coalesce("uidvalidity", F.lit(0)).cast("long"),
        }
    )
    mine = (F.col("imap_user") == account.user) & (F.col("imap_host") == account.host)
    latest = S.latest_sync_state(store.read("mailbox_sync_state").where(mine))
    return S.cursor_join(status, latest, incremental)


def _stamps(store: Store, buckets: list[int]) -> DataFrame:
    """Key and times of the stored documents of some buckets, all else null, dealt by key as the merge deals its rows."""
    stored = store.stored("vector_documents", buckets).select("document_key", "created_at", "updated_at").repartition("document_key")
    return stored.select(*[F.col(f.name) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields])


def ingest_mailbox(
    store: Store,
    messages: DataFrame,
    server_uids: DataFrame,
    folder_state: DataFrame,
    *,
    account: Account,
    folders: Sequence[str],
    days: int,
    today: date | str,
    run_id: str,
    observed_at: datetime | str,
    embedder=HashEmbedder(),
    incremental: bool = True,
    merge_metadata: bool = False,
    strict: bool = False,
    dry_run: bool = False,
) -> IngestReport:
    """One incremental run over the requested folders.

    ``messages`` follow ``schemas.MESSAGE`` plus ``seq`` and ``received_date``; ``server_uids`` is (folder, uid),
    ``folder_state`` (folder, message_count, uidvalidity, uidnext).
    """
    folders = normalize_folders(folders)
    store.bootstrap()
    plan = materialize(fetch_plan(store, folder_state, account, folders, incremental), "fetch-plan")
    fetched = S.range_fetch(messages, plan, days, today)
    uids = server_uids.where(F.col("folder").isin(*folders)).select("folder", "uid")
    newest = uids.groupBy("folder").agg(F.max("uid").alias("last_synced_uid"))
    cursors = plan.select("folder", "uidvalidity", "message_count").join(newest, "folder", "left")
    return persist_messages(
        store, fetched, plan=plan, cursors=cursors, server_uids=uids, account=account, run_id=run_id,
        observed_at=observed_at, embedder=embedder, merge_metadata=merge_metadata, strict=strict, dry_run=dry_run,
        folders=folders,
    )


def persist_messages(
    store: Store,
    fetched: DataFrame,
    *,
    plan: DataFrame,
    cursors: DataFrame,
    server_uids: DataFrame | None,
    account: Account,
    run_id: str,
    observed_at: datetime | str,
    embedder=HashEmbedder(),
    merge_metadata: bool = False,
    strict: bool = False,
    dry_run: bool = False,
    folders: Sequence[str] | None = None,
) -> IngestReport:
    """Normalise, merge, embed and store messages, then reconcile, move the cursors and purge; one commit.

    Without ``server_uids`` nothing is reconciled. The batch is written once after normalising and once
    after merging, because several branches read it; the stored tables are read by columns, and only the
    buckets with a changed key are rewritten, of vectors those with a new or deleted one. An empty batch writes no document.
    """
    moment = F.lit(observed_at).cast("timestamp")
    scratch = fresh_dir(store.spark, "ingest")
    seen: dict[str, Observation] = {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        """Rows are counted by the job that writes them."""
        seen[name] = Observation(name)
        return df.observe(seen[name], F.count(F.lit(1)).alias("rows"))

    ok = normalize_messages(counted(fetched, "total_fetched"), strict, rare_dates=False).ok
    # Texts pass the merge without the searchable copy, and are shuffled by key there and nowhere else.
    normalized = materialize(X.without_copies(counted(ok, "total_normalized"), "subject"), "normalized", scratch)
    if has_rare_dates(normalized):
        normalized = repair_rare_dates(normalized)
    fresh = counted(to_document(merge_duplicates(normalized).ok), "total_deduped")
    if not merge_metadata:
        # Where the merge has brought the texts: of a stored document only its key and its time survive the upsert.
        stamps = _stamps(store, store.touched(normalized.select("fingerprint")))
        fresh = U.upsert_documents(stamps, fresh, observed_at).where(F.col("inserted").isNotNull()).drop("inserted")
    incoming = X.with_copies(materialize(fresh, "incoming", scratch))

    # The batch as it will be stored. Folders are rows of a narrow table: what vanished, and who is left without a folder, is found
    # there, and of the stored documents only the type is read.
    keys = incoming.select("document_key")
    batch = incoming
    if merge_metadata:
        same = store.read("vector_documents", store.touched(keys)).join(keys, "document_key", "left_semi")
        batch = materialize(U.upsert_documents(same, incoming, observed_at, merge_metadata).drop("inserted"), "batch", scratch)
    purged = batch.where(U.is_orphan()).select("document_key")
    if server_uids is None:
        missing = store.spark.createDataFrame([], "document_key string, folder string, folder_ord int, uid long")
    else:
        after = store.stored("document_folders").join(keys, "document_key", "left_anti").unionByName(M.memberships_of(batch))
        with_uid = after.where(F.col("uid").isNotNull()).select("document_key", "folder", "uid")
        if folders is not None:
            with_uid = with_uid.where(F.col("folder").isin(*folders))
        missing = S.reconcile_missing(with_uid, server_uids, plan)
        missing = materialize(counted(missing, "reconciled_missing"), "missing", scratch)
        # Only a document of the batch, or one that has just lost a folder, can have become an orphan.
        losers = missing.select("document_key").distinct()
        left = after.where(F.col("ord").isNotNull()).join(losers, "document_key", "left_semi")
        left = left.join(missing, ["document_key", "folder"], "left_anti").select("document_key")
        types = store.stored("vector_documents").select("document_key", "source_type").join(keys, "document_key", "left_anti")
        emails = types.unionByName(batch.select("document_key", "source_type")).where("source_type = 'email'")
        emptied = losers.join(left, "document_key", "left_anti").join(emails, "document_key", "left_semi")
        purged = purged.union(emptied).distinct()
    purged = materialize(counted(purged, "deleted_stale_documents"), "purged", scratch)

    # Only documents without a current vector are embedded, and only their vectors are joined with stored ones and written. They are
    # found by checksums, before any text is read.
    document_buckets = store.touched(keys, purged)
    old_vectors = store.read("vector_embeddings", document_buckets)
    sums = incoming.select("document_key", "content_checksum")
    stale = E.stale_documents(sums, old_vectors, embedder.provider, embedder.model_name, embedder.dimensions)
    stale = materialize(stale.select("document_key"), "stale", scratch)
    vectors = embedder(incoming.select("document_key", "searchable_text").join(stale, "document_key", "left_semi"))
    vectors = vectors.join(incoming.select("document_key", "content_checksum"), "document_key").withColumn(
        "embedding", round_vector(F.col("vector"))
    )
    same_vectors = old_vectors.join(stale, "document_key", "left_semi")
    upserted = materialize(U.upsert_embeddings(same_vectors, vectors, observed_at), "embeddings", scratch)

    old_documents = store.stored("vector_documents", document_buckets)
    known = old_documents.select("document_key", F.lit(True).alias("known"))
    written = upserted.where("updated").select("document_key").distinct().withColumn("written", F.lit(True))
    persisted = (
        incoming.select("document_key", "title")
        .join(known, "document_key", "left")
        .join(written, "document_key", "left")
        .select(
            F.col("document_key").alias("fingerprint"),
            F.col("title").alias("subject"),
            (F.col("known").isNull() & F.lit(not dry_run)).alias("inserted"),
            (F.col("written").isNotNull() & F.lit(not dry_run)).alias("embedding_updated"),
            F.lit(dry_run).alias("skipped"),
        )
    )
    persisted = materialize(persisted, "persisted")
    names = ["total_fetched", "total_normalized", "total_deduped", "reconciled_missing", "deleted_stale_documents"]
    totals = {name: seen[name].get.get("rows", 0) if name in seen else 0 for name in names}
    modes = plan.select("folder", "sync_mode", "message_count", "uidvalidity", "uidnext")
    if dry_run:
        drop_folder(store.spark, scratch)
        return IngestReport(totals, modes, persisted, None)

    # Untouched rows of a rewritten bucket pass one anti join with the keys of the batch, which is broadcast when small and hashed by
    # bucket when not, so that no text is sorted. A run that only takes documents out of folders rewrites no document.
    many = totals["total_deduped"] > BROADCAST_KEYS
    documents = old_documents.join(keys.hint("shuffle_hash") if many else keys, "document_key", "left_anti")
    documents = documents.unionByName(M.without_memberships(batch))
    documents = documents.join(purged, "document_key", "left_anti")
    folder_buckets = store.touched(keys, missing, purged)
    memberships = M.replace_memberships(store.stored("document_folders", folder_buckets), batch, missing)
    memberships = memberships.join(purged, "document_key", "left_anti")

    vector_buckets = store.touched(stale, purged)
    embeddings = store.read("vector_embeddings", vector_buckets).join(stale.union(purged), "document_key", "left_anti").unionByName(
        upserted.drop("updated").join(purged, "document_key", "left_anti")
    )

    observations = S.present_observations(incoming, run_id, moment).unionByName(
        S.missing_observations(missing, run_id, moment)
    )
    # A run writes the history's partition of its own; a replay replaces it.
    before = store.stored("document_sync_runs").where(F.col("sync_run_id") == run_id)
    runs = U.record_document_sync(before, observations, observed_at).join(purged, "document_key", "left_anti")

    states = cursors.select(
        F.lit(account.user).alias("imap_user"),
        F.lit(account.host).alias("imap_host"),
        F.col("folder").alias("imap_folder"),
        "uidvalidity",
        "last_synced_uid",
        moment.alias("last_sync_time"),
        F.lit(run_id).alias("sync_run_id"),
        F.col("message_count").alias("total_emails_in_folder"),
    )
    version = store.commit(
        {
            "vector_documents": (documents, document_buckets),
            "document_folders": (memberships, folder_buckets),
            "vector_embeddings": (embeddings, vector_buckets),
            "document_sync_runs": (runs, [run_id]),
            "mailbox_sync_state": (U.upsert_sync_state(store.read("mailbox_sync_state"), states, observed_at), None),
        }
    )
    drop_folder(store.spark, scratch)
    return IngestReport(totals, modes, persisted, version)
