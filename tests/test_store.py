import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lettermill import schemas
from lettermill.operators.embed import stale_documents
from lettermill.sinks import memberships
from lettermill.sinks import store as S
from lettermill.sinks import upserts as U
from lettermill.sinks.store import TABLES, Store

THEN, NOW = "2026-01-01 00:00:00", "2026-02-01 00:00:00"


def documents(spark, keys, stamp=THEN, **values):
    columns = {f.name: F.lit(None).cast(f.dataType) for f in schemas.DOCUMENTS.fields}
    columns |= {"source_type": F.lit("note"), "title": F.lit("t"), "content_checksum": F.lit("c")}
    columns |= {"created_at": F.lit(stamp).cast("timestamp"), "updated_at": F.lit(stamp).cast("timestamp")}
    columns |= {k: F.lit(v) for k, v in values.items()}
    rows = spark.createDataFrame([(k,) for k in keys], "document_key string")
    return rows.select("document_key", *[c.alias(n) for n, c in columns.items() if n != "document_key"])


def test_bootstrap_gives_empty_tables(store):
    assert store.version() == 0
    store.bootstrap()
    store.bootstrap()
    assert store.version() == 1
    for name, spec in TABLES.items():
        rows = store.read(name)
        assert rows.schema.names == spec.schema.names and rows.isEmpty()


def test_commit_rewrites_touched_buckets_only(spark, store):
    keys = [f"k{i}" for i in range(40)]
    store.commit({"vector_documents": (documents(spark, keys), None)})
    before = store._current()[1]["vector_documents"]
    assert len(before) == 4 and store.read("vector_documents").count() == 40
    old_view = store.read("vector_documents")

    one = documents(spark, ["k7"], title="new")
    touched = store.touched(one.select("document_key"))
    assert len(touched) == 1
    after = U.upsert_documents(store.read("vector_documents", touched), one, NOW).drop("inserted")
    store.commit({"vector_documents": (after, touched)})
    now = store._current()[1]["vector_documents"]
    assert [b for b in now if now[b] != before[b]] == touched
    rows = {r.document_key: r.title for r in store.read("vector_documents").collect()}
    assert len(rows) == 40 and rows["k7"] == "new" and rows["k8"] == "t"
    assert old_view.where("title = 'new'").isEmpty(), "a reader of the old version is not disturbed"


def test_emptied_bucket_and_failed_commit(spark, store):
    store.commit({"vector_documents": (documents(spark, ["a"]), None)})
    bad = documents(spark, ["b"]).withColumn("title", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        store.commit({"vector_documents": (bad, None)})
    assert store.version() == 1 and [r.document_key for r in store.read("vector_documents").collect()] == ["a"]
    store.commit({"vector_documents": (store.read("vector_documents").where("false"), None)})
    assert store.read("vector_documents").isEmpty()


def test_two_writers_cannot_both_publish(spark, store):
    store.bootstrap()
    with pytest.raises(Exception, match="already exists"):
        store._publish(1, {})


def test_document_upsert(spark):
    old = documents(spark, ["a", "b"], source_id="s")
    new = documents(spark, ["b", "c"], title="new").drop("created_at", "updated_at")
    rows = {r.document_key: r for r in U.upsert_documents(old, new, NOW).collect()}
    assert {k: r.inserted for k, r in rows.items()} == {"a": None, "b": False, "c": True}
    assert rows["b"].title == "new" and rows["b"].source_id is None, "null replaces a stored value"
    assert str(rows["b"].created_at) == THEN and str(rows["b"].updated_at) == NOW
    assert str(rows["a"].updated_at) == THEN and str(rows["c"].created_at) == NOW


EMB = "document_key string, provider string, model_name string, dimensions int, embedding array<double>, content_checksum string"


def test_embedding_upsert(spark):
    stamps = {"created_at": F.lit(THEN).cast("timestamp"), "updated_at": F.lit(THEN).cast("timestamp")}
    old = spark.createDataFrame(
        [("a", "p", "m", 2, [0.0, 0.0], "c1"), ("b", "p", "m", 2, [0.0, 0.0], "c1"), ("c", "p", "m", 2, [0.0, 0.0], "c1"), ("d", "p", "m", 2, [0.0, 0.0], None)], EMB
    ).withColumns(stamps)
    new = spark.createDataFrame(
        [("a", "p", "m", 2, [1.0, 1.0], "c1"), ("b", "p", "m", 2, [1.0, 1.0], "c2"), ("c", "p", "m", 3, [1.0, 1.0, 1.0], "c1"), ("d", "p", "m", 2, [1.0, 1.0], None),
         ("a", "q", "m", 2, [1.0, 1.0], "c1")], EMB
    )
    rows = {(r.document_key, r.provider): r for r in U.upsert_embeddings(old, new, NOW).collect()}
    assert {k: r.updated for k, r in rows.items()} == {("a", "p"): False, ("b", "p"): True, ("c", "p"): True, ("d", "p"): False, ("a", "q"): True}
    assert rows[("a", "p")].embedding == [0.0, 0.0] and rows[("c", "p")].dimensions == 3
    assert str(rows[("a", "p")].updated_at) == THEN and str(rows[("b", "p")].updated_at) == NOW
    docs = spark.createDataFrame([("a", "c1", "t"), ("b", "c2", "t"), ("x", "c1", "t")], "document_key string, content_checksum string, searchable_text string")
    assert sorted(r.document_key for r in stale_documents(docs, old, "p", "m", 2).collect()) == ["b", "x"]
    assert sorted(r.document_key for r in stale_documents(docs, old, "q", "m", 2).collect()) == ["a", "b", "x"]


def test_backfill(spark):
    old = spark.createDataFrame([("a", "m", 1)], "document_key string, model_name string, dimensions int")
    row = U.backfill_embeddings(old).first()
    assert row.provider == "legacy" and row.embedding is None
    runs = spark.createDataFrame([("a", "r", True)], "document_key string, sync_run_id string, was_present_in_mailbox boolean")
    assert U.backfill_sync_runs(runs).first().folder_uids == {}


def test_older_files_without_a_column_read_as_null(spark, store):
    store.commit({"vector_documents": (documents(spark, ["a"]), None)})
    path = next(iter(store._current()[1]["vector_documents"].values()))
    file = pathlib.Path(files_below(path)[0])
    pq.write_table(pq.read_table(file, partitioning=None).drop_columns(["source_id"]), file.with_name(file.name.replace("part-", "old-part-")))
    spark.catalog.refreshTable(store.table_name("vector_documents"))
    assert store.read("vector_documents").where("source_id is null").count() == 2


def test_lookup_of_unknown_document(spark):
    keys = spark.createDataFrame([("a",), ("zz",)], "document_key string")
    docs = documents(spark, ["a"]).select("document_key", "title")
    assert [r.document_key for r in U.unknown_documents(keys, docs).collect()] == ["zz"]
    with pytest.raises(Exception, match="unknown document_key zz"):
        U.lookup_documents(keys, docs).collect()


def mail(spark, rows):
    """Documents from (key, folders, uids, flags)."""
    schema = f"document_key string, folders array<string>, uids {schemas.UID_MAP.simpleString()}, flags {schemas.TERM_MAP.simpleString()}"
    given = spark.createDataFrame(rows, schema)
    own = {"folders": F.col("folders"), "folder_uids": F.col("uids"), "folder_flags": F.col("flags")}
    fields = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.METADATA.fields]
    rows = documents(spark, []).schema
    values = {"metadata": F.struct(*fields), "source_type": F.lit("email"), "created_at": F.lit(THEN).cast("timestamp")}
    return given.select(*[values.get(f.name, F.col("document_key") if f.name == "document_key" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.fields])


def folders_of(frame):
    return {r.document_key: r.metadata and (r.metadata.folders, r.metadata.folder_uids, r.metadata.folder_flags) for r in frame.collect()}


def test_memberships_there_and_back(spark, store):
    rows = [
        ("a", ["INBOX", "Archive"], {"INBOX": 1, "Archive": 2}, {"Archive": ["x"]}), ("b", [], {}, None), ("c", None, None, None),
        ("d", ["Z", "A", "Z"], {"A": None, "only-uid": 7}, {"only-flag": []}),
    ]
    given = mail(spark, rows).unionByName(documents(spark, ["note"]))
    store.commit({"vector_documents": (given, None)})
    assert folders_of(store.read("vector_documents")) == {
        "a": (["INBOX", "Archive"], {"INBOX": 1, "Archive": 2}, {"Archive": ["x"]}), "b": ([], {}, None), "c": (None, None, None),
        "d": (["Z", "A"], {"only-uid": 7}, {"only-flag": []}), "note": None,
    }
    stored = store.stored("vector_documents").where("metadata is not null").select("metadata.folders", "metadata.folder_uids").collect()
    assert all(not r.folders and not r.folder_uids for r in stored), "folders are stored once, as rows"


def test_removing_memberships_writes_no_document(spark, store):
    many = [(f"k{i}", ["INBOX", "Archive"], {"INBOX": i, "Archive": i}, None) for i in range(20)]
    store.commit({"vector_documents": (mail(spark, many), None)})
    before = store._current()[1]["vector_documents"]
    missing = spark.createDataFrame([("k3", "INBOX"), ("k3", "INBOX"), ("k5", "Archive")], "document_key string, folder string")
    touched = store.touched(missing)
    after = memberships.replace_memberships(store.stored("document_folders", touched), mail(spark, []), missing)
    store.commit({"document_folders": (after, touched)})
    assert store._current()[1]["vector_documents"] == before
    found = folders_of(store.read("vector_documents"))
    assert found["k3"][:2] == (["Archive"], {"Archive": 3}) and found["k5"][0] == ["INBOX"] and found["k4"][0] == ["INBOX", "Archive"]


def observed(spark, run, keys, stamp=NOW):
    rows = [(k, run, True) for k in keys]
    own = U.backfill_sync_runs(spark.createDataFrame(rows, "document_key string, sync_run_id string, was_present_in_mailbox boolean"))
    return own.withColumn("created_at", F.lit(stamp).cast("timestamp"))


def files_below(path):
    return sorted(str(p) for p in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet"))


def test_history_is_append_only(spark, store):
    store.commit({"vector_documents": (documents(spark, ["a", "b"]), None)})
    store.commit({"document_sync_runs": (observed(spark, "run/1", ["a", "b"]), ["run/1"])})
    first = files_below(f"{store.root}/document_sync_runs")
    store.commit({"document_sync_runs": (observed(spark, "run-2", ["a"]), ["run-2"])})
    second = files_below(f"{store.root}/document_sync_runs")
    assert set(first) < set(second), "old partitions keep their files"
    # A replay replaces its own partition and no other.
    store.commit({"document_sync_runs": (observed(spark, "run-2", ["a", "b"]), ["run-2"])})
    third = files_below(f"{store.root}/document_sync_runs")
    assert set(first) < set(third) and not (set(second) - set(first)) & set(third)
    seen = sorted((r.sync_run_id, r.document_key) for r in store.read("document_sync_runs").collect())
    assert seen == [("run-2", "a"), ("run-2", "b"), ("run/1", "a"), ("run/1", "b")]


def test_history_of_an_unpublished_run_is_not_seen(spark, store, monkeypatch):
    store.commit({"vector_documents": (documents(spark, ["a"]), None)})
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.commit({"document_sync_runs": (observed(spark, "run-1", ["a"]), ["run-1"])})
    store.commit({"document_sync_runs": (observed(spark, "run-2", ["a"]), ["run-2"])})
    assert [r.sync_run_id for r in store.read("document_sync_runs").collect()] == ["run-2"]


def test_history_goes_with_its_document(spark, store):
    runs = observed(spark, "run-1", ["a", "b"], "2026-01-15 00:00:00")
    store.commit({"vector_documents": (documents(spark, ["a", "b"]), None), "document_sync_runs": (runs, ["run-1"])})
    store.commit({"vector_documents": (documents(spark, ["b"]), None)})
    assert [r.document_key for r in store.read("document_sync_runs").collect()] == ["b"]
    # A later document of the same key has a history of its own.
    later = documents(spark, ["a"], NOW).unionByName(documents(spark, ["b"]))
    store.commit({"vector_documents": (later, None), "document_sync_runs": (observed(spark, "run-2", ["a"]), ["run-2"])})
    seen = sorted((r.document_key, r.sync_run_id) for r in store.read("document_sync_runs").collect())
    assert seen == [("a", "run-2"), ("b", "run-1")]


def test_one_scan_after_many_commits(spark, store):
    for i in range(12):
        one = documents(spark, [f"k{i}"])
        touched = store.touched(one.select("document_key"))
        kept = store.stored("vector_documents", touched)
        store.commit({"vector_documents": (kept.unionByName(one), touched)})
    rows = store.stored("vector_documents")
    assert rows.count() == 12 and len(set(p.split("/key_bucket=")[0] for p in store._current()[1]["vector_documents"].values())) > 1
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def plan_above_scans(frame):
    """(operators from the root to each table scan), by indentation of the plan."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "FileScan" in line:
            above, level = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < level:
                    above.append(lines[j])
                    level = depth[j]
            yield line, above


def test_upserts_do_not_shuffle_the_stored_side(spark, store):
    """The joins by key use the buckets; only the batch is brought to them."""
    store.commit({"vector_documents": (documents(spark, [f"k{i}" for i in range(30)]), None)})
    vectors = spark.createDataFrame([(f"k{i}", "p", "m", 1, [1.0], "c") for i in range(30)], EMB)
    stamped = vectors.withColumns({"created_at": F.lit(THEN).cast("timestamp"), "updated_at": F.lit(THEN).cast("timestamp")})
    store.commit({"vector_embeddings": (stamped, None)})
    batch = documents(spark, ["k3", "new"], title="new")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = U.upsert_documents(store.stored("vector_documents"), batch, NOW)
        two = U.upsert_embeddings(store.stored("vector_embeddings"), vectors.limit(3), NOW)
        for frame in (one, two):
            [(line, above)] = list(plan_above_scans(frame))
            assert "Bucketed: true" in line and not any("Exchange" in operator for operator in above)
        assert one.where("inserted").count() == 1 and one.count() == 31 and two.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_sees_the_same_store(spark, store):
    store.commit({"vector_documents": (documents(spark, ["a", "b"]), None)})
    other = Store(spark.newSession(), store.root, buckets=4)
    assert other.read("vector_documents").count() == 2
    spark.sql(f"DROP TABLE {store.table_name('vector_documents')}")  # a catalog that knows nothing of it
    fresh = Store(spark, store.root, buckets=4)
    assert fresh.read("vector_documents").count() == 2
    fresh.commit({"vector_documents": (documents(spark, ["c"]), None)})
    late = Store(spark, store.root, buckets=4)
    assert [r.document_key for r in late.read("vector_documents").collect()] == ["c"]


def test_searchable_texts_are_stored_once(spark, store):
    """Title and body are not written a second time; any other searchable text comes back as it was. Files are in zstd."""
    rows = [("a", "t", "body", "t\n\nbody"), ("b", None, "body", "body"), ("c", "t", "", "t"), ("d", "t", "body", None), ("e", "t", "body", ""),
            ("f", "t", "body", "\x00"), ("g", "t", "body", "\x00own"), ("h", None, None, ""), ("i", "t", "body", "own")]
    given = spark.createDataFrame(rows, "document_key string, title string, body string, searchable_text string")
    blank = documents(spark, [r[0] for r in rows]).drop("title", "body", "searchable_text")
    store.commit({"vector_documents": (blank.join(given, "document_key"), None)})
    found = store.read("vector_documents").select("document_key", "title", "body", "searchable_text").collect()
    assert sorted(map(tuple, found)) == rows
    files = [pq.ParquetFile(f) for path in store._current()[1]["vector_documents"].values() for f in files_below(path)]
    written = {k: t for f in files for k, t in zip(*f.read(["document_key", "searchable_text"]).to_pydict().values(), strict=True)}
    assert written["a"] == written["b"] == written["c"] == "\x00" and written["i"] == "own"
    assert {f.metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_long_rows_are_written_where_they_are(spark, store, monkeypatch):
    """With few buckets a task writes a file for each of them; a shuffle brought every text to its bucket."""
    rows = documents(spark, [f"k{i}" for i in range(120)]).repartition(3, F.col("title"), F.col("document_key"))
    per_bucket = []
    for most in (S.FILES_OF_A_TASK, 3):
        monkeypatch.setattr(S, "FILES_OF_A_TASK", most)
        store.commit({"vector_documents": (rows, None)})
        per_bucket.append({len(files_below(path)) for path in store._current()[1]["vector_documents"].values()})
        assert sorted(r.document_key for r in store.read("vector_documents").collect()) == sorted(f"k{i}" for i in range(120))
    assert per_bucket == [{3}, {1}]
