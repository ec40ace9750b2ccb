import re

import pytest
from pyspark.sql import functions as F

from lettermill.operators import sync as S
from lettermill.plans import ingest
from lettermill.plans.ingest import Account, HashEmbedder, ModelEmbedder, ingest_mailbox, run_counters
from lettermill.session import fresh_dir, materialize
from lettermill.sinks.store import Store
from lettermill.streaming.ingest import ingest_batch, stream_ingest

ME = Account("user@example.com")
SMALL = HashEmbedder(dimensions=8)


def mail(spark, *rows):
    """(id, folder, uid[, body]) tuples."""
    full = [(r[2], f"<{r[0]}@example.com>", f"Subject {r[0]}", r[3] if len(r) > 3 else "Body", r[1], r[2], "Fri, 11 Apr 2026 09:15:00 +0000") for r in rows]
    df = spark.createDataFrame(full, "seq long, message_id string, subject string, body string, folder string, imap_uid long, date_raw string")
    return df.withColumn("received_date", F.lit("2026-04-11").cast("date"))


def state(spark, *rows):
    return spark.createDataFrame(list(rows), "folder string, message_count long, uidvalidity long, uidnext long")


def uids(spark, **folders):
    return spark.createDataFrame([(f, u) for f, us in folders.items() for u in us], "folder string, uid long")


def run(store, messages, server, status, run_id, folders=("INBOX", "Archive"), day=11, **options):
    return ingest_mailbox(
        store, messages, server, status, account=ME, folders=folders, days=3, today="2026-04-12", run_id=run_id,
        observed_at=f"2026-04-{day} 10:00:00", embedder=options.pop("embedder", SMALL), **options,
    )


def doc(store, number):
    return store.read("vector_documents").where(F.col("source_id") == f"<{number}@example.com>").first()


def seed(spark, store, uid_rows, cursor_uids=(1, 1), validity=999):
    """Documents known by UID: an incremental run from an old cursor, as a full scan knows no UIDs."""
    rows = [(ME.user, ME.host, f, validity, c, "2026-04-01 00:00:00") for f, c in zip(("INBOX", "Archive"), cursor_uids)]
    cursors = spark.createDataFrame(rows, "imap_user string, imap_host string, imap_folder string, uidvalidity long, last_synced_uid long, t string")
    now = F.col("t").cast("timestamp")
    cursors = cursors.select("*", now.alias("last_sync_time"), F.lit("run-0").alias("sync_run_id"), F.lit(0).cast("long").alias("total_emails_in_folder"), now.alias("created_at"), now.alias("updated_at"))
    store.commit({"mailbox_sync_state": (cursors, None)})
    server = uids(spark, **{f: [r[2] for r in uid_rows if r[1] == f] for f in ("INBOX", "Archive")})
    status = state(spark, *[(f, 0, validity, max([r[2] for r in uid_rows if r[1] == f], default=0) + 1) for f in ("INBOX", "Archive")])
    return run(store, mail(spark, *uid_rows), server, status, "run-1")


def test_incremental_run_reconciles_and_purges(spark, store):
    seed(spark, store, [("stale", "INBOX", 100), ("current", "INBOX", 101), ("stale2", "Archive", 7), ("both", "INBOX", 99), ("both", "Archive", 8)])
    assert store.read("vector_documents").count() == 4
    assert doc(store, "both").metadata.folders == ["INBOX", "Archive"]
    # UIDs 100 and 7 are gone; "both" has left INBOX; 102 is new.
    server = uids(spark, INBOX=[101, 102], Archive=[8])
    status = state(spark, ("INBOX", 2, 999, 103), ("Archive", 1, 999, 9))
    report = run(store, mail(spark, ("new", "INBOX", 102)), server, status, "run-2", day=12)
    assert report.totals == {"total_fetched": 1, "total_normalized": 1, "total_deduped": 1, "reconciled_missing": 3, "deleted_stale_documents": 2}
    assert {r.folder: r.sync_mode for r in report.folders.collect()} == {"INBOX": "incremental", "Archive": "incremental"}
    assert [(r.subject, r.inserted, r.embedding_updated) for r in report.persisted.collect()] == [("Subject new", True, True)]
    both = doc(store, "both").metadata
    assert both.folders == ["Archive"] and both.folder_uids == {"Archive": 8}
    assert doc(store, "stale") is None and doc(store, "stale2") is None
    keys = {r.document_key for r in store.read("vector_documents").collect()}
    for child in ("vector_embeddings", "document_sync_runs"):
        assert {r.document_key for r in store.read(child).collect()} <= keys
    missing = store.read("document_sync_runs").where("sync_run_id = 'run-2' AND NOT was_present_in_mailbox").collect()
    assert [(r.document_key, r.folder_names, r.folder_uids) for r in missing] == [(doc(store, "both").document_key, ["INBOX"], {"INBOX": 99})]
    cursors = {(r.imap_folder): (r.last_synced_uid, r.total_emails_in_folder, r.sync_run_id) for r in store.read("mailbox_sync_state").collect()}
    assert cursors == {"INBOX": (102, 2, "run-2"), "Archive": (8, 1, "run-2")}


def test_missing_from_two_folders_in_one_run(spark, store):
    seed(spark, store, [("a", "INBOX", 5), ("a", "Archive", 6), ("keep", "INBOX", 4)])
    extra = mail(spark, ("a", "Drafts", 3))
    status = state(spark, ("INBOX", 1, 999, 6), ("Archive", 0, 999, 7), ("Drafts", 1, 1, 4))
    # The message is re-read from Drafts (a first, full scan), so its old memberships are replaced.
    report = run(store, extra, uids(spark, INBOX=[4], Drafts=[3]), status, "run-2", folders=("INBOX", "Archive", "Drafts"))
    assert report.totals["reconciled_missing"] == 0 and doc(store, "a").metadata.folders == ["Drafts"]
    other = Store(spark, fresh_dir(spark, "test-store"), buckets=4)
    seed(spark, other, [("a", "INBOX", 5), ("a", "Archive", 6), ("keep", "INBOX", 4)])
    report = run(other, extra, uids(spark, INBOX=[4], Drafts=[3]), status, "run-2", folders=("INBOX", "Archive", "Drafts"), merge_metadata=True)
    assert report.totals["reconciled_missing"] == 2
    assert doc(other, "a").metadata.folders == ["Drafts"]
    row = other.read("document_sync_runs").where("sync_run_id = 'run-2' AND document_key = '%s'" % doc(other, "a").document_key).collect()
    assert [(r.was_present_in_mailbox, r.folder_names) for r in row] == [(False, ["Archive"])], "the last folder wins"


def test_full_scan_when_the_cursor_is_invalid(spark, store):
    seed(spark, store, [("a", "INBOX", 5)])
    status = state(spark, ("INBOX", 1, 1000, 6), ("Archive", 0, 999, None))
    report = run(store, mail(spark, ("a", "INBOX", 5), ("b", "INBOX", 4)), uids(spark, INBOX=[4, 5]), status, "run-2")
    modes = {r.folder: r.sync_mode for r in report.folders.collect()}
    assert modes == {"INBOX": "full", "Archive": "full"}, "Archive has no cursor value, INBOX another UIDVALIDITY"
    assert report.totals["total_fetched"] == 2
    assert doc(store, "a").metadata.folder_uids == {}, "a full scan knows no UIDs"
    assert store.read("mailbox_sync_state").where("imap_folder = 'INBOX'").count() == 2
    forced = run(store, mail(spark, ("a", "INBOX", 5)), uids(spark, INBOX=[4, 5]), status, "run-3", incremental=False)
    assert {r.sync_mode for r in forced.folders.collect()} == {"full"}


def test_full_scan_without_uidvalidity_is_not_reconciled(spark, store):
    seed(spark, store, [("a", "INBOX", 5)])
    status = state(spark, ("INBOX", 0, 0, 6), ("Archive", 0, 999, 1))
    report = run(store, mail(spark, ("x", "Other", 1)), uids(spark, Other=[1]), status, "run-2")
    assert report.totals["reconciled_missing"] == 0 and doc(store, "a") is not None


def test_cursor_rules(spark):
    status = spark.createDataFrame([("a", 0, 1, 9), ("b", 1, 1, None), ("c", 2, 1, 6), ("d", 3, 2, 9), ("e", 4, 1, 9)], "folder string, folder_ord int, uidvalidity long, uidnext long")
    latest = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("d", 1, 5), ("e", 1, None)], "imap_folder string, uidvalidity long, last_synced_uid long")
    got = {r.folder: (r.sync_mode, r.start_uid, r.end_uid) for r in S.cursor_join(status, latest).collect()}
    assert got == {"a": ("incremental", 6, 8), "b": ("incremental", None, None), "c": ("incremental", None, None), "d": ("full", None, None), "e": ("full", None, None)}


@pytest.mark.parametrize("limits", [(200, 100_000), (0, 100_000), (0, 0)])
def test_fetch_is_the_same_with_literals_broadcast_or_join(spark, monkeypatch, limits):
    monkeypatch.setattr(S, "LITERAL_FOLDERS", limits[0])
    monkeypatch.setattr(S, "BROADCAST_FOLDERS", limits[1])
    plan = spark.createDataFrame(
        [("INBOX", 0, "incremental", 2, 3), ("Archive", 1, "full", None, None), ("Old", 2, "incremental", None, None)],
        "folder string, folder_ord int, sync_mode string, start_uid long, end_uid long",
    )
    messages = mail(spark, *[("m", f, u) for f in ("INBOX", "Archive", "Old", "Else") for u in (1, 2, 3, 4)])
    rows = S.range_fetch(messages, plan, 3, "2026-04-12").collect()
    assert sorted((r.folder, r.imap_uid, r.seq.folder_ord) for r in rows if r.folder == "INBOX") == [("INBOX", 2, 0), ("INBOX", 3, 0)]
    assert [r.imap_uid for r in rows if r.folder == "Archive"] == [None] * 4 and len(rows) == 6


def test_fetch_predicates_reach_the_scan(spark):
    path = fresh_dir(spark, "messages")
    mail(spark, ("m", "INBOX", 1), ("n", "Archive", 2)).write.partitionBy("folder").parquet(path)
    plan = spark.createDataFrame([("INBOX", 0, "incremental", 1, 3)], "folder string, folder_ord int, sync_mode string, start_uid long, end_uid long")
    text = S.range_fetch(spark.read.parquet(path), plan, 3, "2026-04-12")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(imap_uid,1)" in text and "PartitionFilters: [isnotnull(folder" in text


def test_rerun_is_idempotent_and_dry_run_writes_nothing(spark, store):
    rows = [("a", "INBOX", 5), ("b", "Archive", 6)]
    server, status = uids(spark, INBOX=[5], Archive=[6]), state(spark, ("INBOX", 1, 9, 6), ("Archive", 1, 9, 7))
    dry = run(store, mail(spark, *rows), server, status, "run-d", dry_run=True)
    assert dry.version is None and store.read("vector_documents").isEmpty()
    assert run_counters(dry.persisted).first().asDict() == {"fetched": 2, "inserted": 0, "embedding_updates": 0, "skipped": 2}
    first = run(store, mail(spark, *rows), server, status, "run-1")
    assert run_counters(first.persisted).first().asDict() == {"fetched": 2, "inserted": 2, "embedding_updates": 2, "skipped": 0}
    vectors = {r.document_key: r.embedding for r in store.read("vector_embeddings").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in vectors.values())
    again = run(store, mail(spark, *rows), server, status, "run-1", day=12, incremental=False)
    assert run_counters(again.persisted).first().asDict() == {"fetched": 2, "inserted": 0, "embedding_updates": 0, "skipped": 0}
    assert store.read("document_sync_runs").count() == 2
    assert {r.document_key: r.embedding for r in store.read("vector_embeddings").collect()} == vectors
    empty = run(store, mail(spark, *rows), server, status, "run-3", day=13)
    assert empty.totals["total_fetched"] == 0 and store.read("vector_documents").count() == 2


def test_model_with_fallback(spark, store):
    def refuses(texts):
        raise ValueError("primary failed")

    rows = mail(spark, ("a", "INBOX", 5))
    server, status = uids(spark, INBOX=[5]), state(spark, ("INBOX", 1, 9, 6))
    with pytest.raises(Exception, match="primary failed"):
        run(store, rows, server, status, "run-1", embedder=ModelEmbedder(refuses, "demo", "m"))
    assert store.read("vector_documents").isEmpty(), "a failed run leaves nothing behind"
    run(store, rows, server, status, "run-1", embedder=ModelEmbedder(refuses, "demo", "m", fallback=True))
    assert [(r.provider, r.dimensions) for r in store.read("vector_embeddings").collect()] == [("hashing", 256)]


def test_strict_mode_and_rejects(spark, store):
    rows = mail(spark, ("a", "INBOX", 5), ("b", "INBOX", 6)).withColumn("body", F.when(F.col("seq") == 5, F.col("body"))).withColumn("subject", F.when(F.col("seq") == 5, F.col("subject")))
    server, status = uids(spark, INBOX=[5, 6]), state(spark, ("INBOX", 2, 9, 7))
    with pytest.raises(Exception, match="neither subject nor body"):
        run(store, rows, server, status, "run-1", strict=True)
    totals = run(store, rows, server, status, "run-1").totals
    assert (totals["total_fetched"], totals["total_normalized"]) == (2, 1)


def test_stream_resumes_and_survives_a_replay(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    options = dict(account=ME, stream_name="s", observed_at=lambda: "2026-04-11 10:00:00", uidvalidity=7, embedder=SMALL)

    def arrive(*rows):
        mail(spark, *rows).coalesce(1).write.mode("append").parquet(source)

    def consume():
        schema = mail(spark, ("x", "INBOX", 1)).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_ingest(store, stream, checkpoint, **options).awaitTermination()

    arrive(("a", "INBOX", 1), ("b", "INBOX", 2))
    arrive(("a", "Archive", 9))
    consume()
    assert store.read("vector_documents").count() == 2
    assert doc(store, "a").metadata.folder_uids == {"INBOX": 1, "Archive": 9}
    version = store.version()
    consume()
    assert store.version() == version, "nothing new, no batch"
    arrive(("c", "INBOX", 3))
    consume()
    cursors = {r.imap_folder: (r.last_synced_uid, r.total_emails_in_folder) for r in store.read("mailbox_sync_state").collect()}
    assert store.read("vector_documents").count() == 3 and cursors == {"INBOX": (3, 3), "Archive": (9, 1)}
    snapshot = sorted(map(str, store.read("vector_documents").drop("updated_at").collect()))
    ingest_batch(store, mail(spark, ("c", "INBOX", 3)), account=ME, run_id="s-2", observed_at="2026-04-11 11:00:00", uidvalidity=7, embedder=SMALL)
    assert sorted(map(str, store.read("vector_documents").drop("updated_at").collect())) == snapshot
    again = {r.imap_folder: (r.last_synced_uid, r.total_emails_in_folder) for r in store.read("mailbox_sync_state").collect()}
    assert again == cursors and store.read("document_sync_runs").count() == 4


def test_a_run_that_only_removes_writes_no_document(spark, store):
    seed(spark, store, [("a", "INBOX", 100), ("both", "INBOX", 99), ("both", "Archive", 8)])
    before = store._current()[1]
    status = state(spark, ("INBOX", 1, 999, 101), ("Archive", 1, 999, 9))
    report = run(store, mail(spark), uids(spark, INBOX=[100], Archive=[8]), status, "run-2", day=12)
    assert report.totals["reconciled_missing"] == 1 and report.totals["deleted_stale_documents"] == 0
    after = store._current()[1]
    for table in ("vector_documents", "vector_embeddings"):
        assert after[table] == before[table]
    assert after["document_folders"] != before["document_folders"]
    assert doc(store, "both").metadata.folders == ["Archive"]


def test_mail_is_read_once(spark, store, tmp_path):
    messages = mail(spark, *[(i, "INBOX", i) for i in range(1, 30)])
    folder = str(tmp_path)

    def noted(batches):
        import uuid

        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(str(len(batch)))
            yield batch

    read = messages.mapInArrow(noted, messages.schema)
    report = run(store, read, uids(spark, INBOX=list(range(1, 30))), state(spark, ("INBOX", 29, 1, 30)), "run-1", folders=("INBOX",))
    assert report.totals["total_fetched"] == 29
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 29


def test_a_rerun_writes_no_vector_and_moves_texts_once(spark, store, monkeypatch):
    """It rewrote all vectors of the touched buckets, and shuffled the texts to look for stale vectors and for the upsert."""
    rows = [(i, folder, n + 1) for n, (i, folder) in enumerate([(i, f) for i in range(20) for f in ("INBOX", "Archive")])]
    server, status = uids(spark, INBOX=list(range(1, 41)), Archive=list(range(1, 41))), state(spark, ("INBOX", 20, 9, 41), ("Archive", 20, 9, 41))
    run(store, mail(spark, *rows), server, status, "run-1")
    before = store._current()[1]["vector_embeddings"]
    plans = {}

    def noted(frame, name, *folder):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return materialize(frame, name, *folder)

    monkeypatch.setattr(ingest, "materialize", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changed = [r + ("Other",) if r[0] == 3 else r for r in rows if r[0] != 4]
        run(store, mail(spark, *[r for r in rows if r[0] != 4]), server, status, "run-2", day=12, incremental=False)
        assert store._current()[1]["vector_embeddings"] == before
        assert not re.search("body|searchable_text", plans["stale"])
        moved = [line for line in plans["incoming"].splitlines() if "Aggregate" in line and "body" in line]
        assert len(moved) == 2, "one partial and one final aggregation have texts"
        monkeypatch.setattr(ingest, "BROADCAST_KEYS", 0)
        report = run(store, mail(spark, *changed), server, status, "run-3", day=13, incremental=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.subject, r.inserted) for r in report.persisted.where("embedding_updated").collect()] == [("Subject 3", False)]
    now = store._current()[1]["vector_embeddings"]
    assert len([b for b in now if now[b] != before[b]]) == 1, "the bucket of the changed text"
    found = {r.source_id[1:].split("@")[0]: r for r in store.read("vector_documents").collect()}
    assert sorted(map(int, found)) == list(range(20)) and store.read("vector_embeddings").count() == 20
    for number, r in found.items():
        body = "Other" if number == "3" else "Body"
        assert (r.title, r.body, r.searchable_text) == (f"Subject {number}", body, f"Subject {number}\n\n{body}")
        assert sorted(r.metadata.folders) == ["Archive", "INBOX"]
        assert (r.created_at.day, r.updated_at.day) == (11, 11 if number == "4" else 13)
