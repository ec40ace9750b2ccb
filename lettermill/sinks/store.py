"""Stored tables: immutable parquet folders and one small list that says which of them are current.

Plain parquet has no MERGE and cannot be overwritten while it is read. A write therefore goes to new
folders, and a commit publishes one new version of the folder list; readers of the old version are not
disturbed, and a job that dies before its commit leaves the tables as they were. Big tables are Spark's bucketed tables
below the store's folder, partitioned by write and bucket: a small batch rewrites the buckets it touches and no others, a read is one scan, and a
join or aggregation by the key does not shuffle the stored side. Folder memberships of documents are a narrow table of their own, and the
run history is append-only: a partition for each run.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill import schemas
from lettermill.sinks import memberships as M
from lettermill.sinks import texts as X
from lettermill.sinks import upserts as U

BUCKET, WRITE = "key_bucket", "write_id"
_LIST_SCHEMA = "table string, bucket int, path string"
#: Up to so many buckets a task writes its long rows to a file for each; with more of them a bucket is brought together first.
FILES_OF_A_TASK = 32


@dataclass(frozen=True)
class TableSpec:
    schema: T.StructType
    key: str | None = None  # bucketed by this column; None for tables that are replaced as a whole
    partition_by: tuple[str, ...] = ()
    append_by: str | None = None  # append-only: a write replaces the partitions of this column that it has rows of
    wide: bool = False  # long rows, which are not shuffled for the sake of fewer files


TABLES: dict[str, TableSpec] = {
    "vector_documents": TableSpec(schemas.DOCUMENTS, "document_key", wide=True),
    "vector_embeddings": TableSpec(schemas.EMBEDDINGS, "document_key", ("provider", "model_name"), wide=True),
    "document_folders": TableSpec(schemas.DOCUMENT_FOLDERS, "document_key"),
    "document_sync_runs": TableSpec(schemas.SYNC_RUNS, append_by="sync_run_id"),
    "mailbox_sync_state": TableSpec(schemas.SYNC_STATE),
    "task_areas": TableSpec(schemas.TASK_AREAS),
    "task_projects": TableSpec(schemas.TASK_PROJECTS),
    "task_headings": TableSpec(schemas.TASK_HEADINGS),
    "task_todos": TableSpec(schemas.TASK_TODOS),
    "task_checklist_items": TableSpec(schemas.TASK_CHECKLIST_ITEMS),
    "task_notes": TableSpec(schemas.TASK_NOTES),
}


class Store:
    """Tables below ``root``, a folder that all executors reach. ``buckets`` is fixed for the life of a store;
    choose it so that one bucket of the documents is about one to a few hundred megabytes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._known: tuple[int, dict[str, dict[int, str]]] = (0, {})
        self._listed: dict[str, set[str]] = {}  # writes whose partitions this session's catalog has, by table

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)  # noqa: SLF001
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path  # noqa: SLF001

    def _children(self, name: str) -> list[str]:
        """Names inside a folder of the shared file system; none if it does not exist."""
        files, path = self._folder(name)
        return [entry.getPath().getName() for entry in files.listStatus(path)] if files.exists(path) else []

    def version(self) -> int:
        """The newest published version, 0 before the first."""
        found = [int(name[1:]) for name in self._children(f"{self.root}/current") if name.startswith("v")]
        for version in sorted(found, reverse=True):
            if "_SUCCESS" in self._children(f"{self.root}/current/v{version}"):
                return version
        return 0

    def _current(self) -> tuple[int, dict[str, dict[int, str]]]:
        """Version and folder per table and bucket: at most tables x buckets short rows, read once per version."""
        version = self.version()
        if version != self._known[0]:
            rows = self.spark.read.schema(_LIST_SCHEMA).json(f"{self.root}/current/v{version}").collect()
            folders: dict[str, dict[int, str]] = {}
            for row in rows:
                if row.table and not TABLES[row.table].append_by:
                    folders.setdefault(row.table, {})[row.bucket] = row.path
            self._known = (version, folders)
        return self._known[0], {table: dict(by_bucket) for table, by_bucket in self._known[1].items()}

    def bootstrap(self) -> None:
        """Create the first, empty version if there is none."""
        if self.version() == 0:
            self._publish(1, {})

    def _publish(self, version: int, folders: dict[str, dict[int, str]], appended: list[tuple[str, int, str]] = ()) -> None:
        rows = [(t, b, p) for t, by_bucket in folders.items() for b, p in by_bucket.items()] + list(appended) or [("", -1, "")]
        # One file per version and an error if the version exists: two writers cannot both win.
        self.spark.createDataFrame(rows, _LIST_SCHEMA).coalesce(1).write.json(f"{self.root}/current/v{version}")

    def bucket_of(self, key: Column) -> Column:
        """Spark's own bucket of a key, so that a partition of ``key_bucket`` holds files of this bucket alone."""
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")

    def table_name(self, table: str) -> str:
        """The name of a bucketed table in the session's catalog; its data stay in the store's folder."""
        return f"lettermill_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{table}_{self.buckets}"

    def _layout(self, table: str) -> list[str]:
        """Columns in the order of the bucketed table: those it is partitioned by come last."""
        spec = TABLES[table]
        return [c for c in spec.schema.names if c not in spec.partition_by] + [WRITE, BUCKET, *spec.partition_by]

    def _declare(self, table: str, writes: set[str]) -> str:
        """Make the table known to the session, with the partitions of the given writes."""
        spec, name = TABLES[table], self.table_name(table)
        if table not in self._listed:
            kinds = {f.name: f.dataType.simpleString() for f in spec.schema.fields} | {WRITE: "string", BUCKET: "int"}
            columns = ", ".join(f"`{c}` {kinds[c]}" for c in self._layout(table))
            partitions = ", ".join([WRITE, BUCKET, *spec.partition_by])
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({partitions}) "
                f"CLUSTERED BY ({spec.key}) SORTED BY ({spec.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{table}'"
            )
            self._listed[table] = set()
        if not writes <= self._listed[table]:  # of another session
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            self._listed[table] |= writes
        return name

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets that hold the given keys; a list no longer than ``buckets``."""
        buckets = [k.select(self.bucket_of(F.col(k.columns[0])).alias(BUCKET)) for k in keys]
        return [r[0] for r in reduce(DataFrame.union, buckets).distinct().collect()]

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the current version, or only some of its buckets. Columns that older files lack are null.

        Documents have the folders of ``document_folders`` in their metadata. Observations are those of published runs whose document
        is still the one that was observed: deleting a document deletes its history, and a later one of the same key has its own.
        """
        if table == "vector_documents":
            return M.with_memberships(self.stored(table, buckets), self.stored("document_folders", buckets))
        if table == "document_sync_runs":
            documents = self.stored("vector_documents").select("document_key", F.col("created_at").alias("_since"))
            seen = U.backfill_sync_runs(self.stored(table))
            alive = (seen["document_key"] == documents["document_key"]) & (seen["created_at"] >= documents["_since"])
            return seen.join(documents, alive, "left_semi")
        return self.stored(table, buckets)

    def stored(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of one table as they are written, read by a single scan however many commits wrote them."""
        spec = TABLES[table]
        if spec.append_by:
            return self._published(table, spec)
        by_bucket = self._current()[1].get(table, {})
        paths = [p for b, p in by_bucket.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], spec.schema)
        if spec.key is None:
            return self.spark.read.schema(spec.schema).parquet(*paths).select(*spec.schema.names)
        places = [path.removeprefix(f"{self.root}/{table}/{WRITE}=").split(f"/{BUCKET}=") for path in paths]
        rows = self.spark.table(self._declare(table, {write for write, _ in places}))
        current = F.concat_ws("/", WRITE, BUCKET).isin([f"{write}/{bucket}" for write, bucket in places])
        rows = rows.where(current).select(*spec.schema.names)
        return X.with_copies(rows) if table == "vector_documents" else rows

    def _published(self, table: str, spec: TableSpec) -> DataFrame:
        """Rows of the partitions that a published version names. Each version names its own, so no list of all runs is kept."""
        if not self._children(f"{self.root}/{table}"):
            return self.spark.createDataFrame([], spec.schema)
        rows = self.spark.read.schema(spec.schema).parquet(f"{self.root}/{table}").select(*spec.schema.names)
        newest = self.version()
        versions = [name for name in self._children(f"{self.root}/current") if name.startswith("v") and int(name[1:]) <= newest]
        named = self.spark.read.schema(_LIST_SCHEMA).json([f"{self.root}/current/{name}" for name in versions])
        named = named.where(F.col("table") == table).select(F.col("path").alias("_named"))
        return rows.join(named, F.col(spec.append_by) == F.col("_named"), "left_semi")

    def commit(self, changes: dict[str, tuple[DataFrame, list[int] | None]]) -> int:
        """Write the new content of tables and publish all of it at once.

        ``changes`` maps a table to its new rows and the buckets these rows fully replace (None for all). Documents that come without
        their ``document_folders`` bring them in their metadata. For an append-only table the values of the partitions are given.
        """
        version, folders = self._current()
        changes = dict(changes)
        if "vector_documents" in changes:
            rows, buckets = changes["vector_documents"]
            changes.setdefault("document_folders", (M.memberships_of(rows), buckets))
            changes["vector_documents"] = (X.without_copies(M.without_memberships(rows)), buckets)
        appended = [(t, -1, value) for t, (_, values) in changes.items() if TABLES[t].append_by for value in values]

        def write(table: str) -> dict[int, str]:
            rows, buckets = changes[table]
            spec = TABLES[table]
            rows = rows.select(*spec.schema.names)
            if spec.append_by:
                # Only the partitions of these values are replaced: a retry of a run replaces what it has written before.
                target = rows.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                target.partitionBy(spec.append_by).parquet(f"{self.root}/{table}")
                return {}
            own = f"{version + 1}-{uuid.uuid4().hex}"
            folder = f"{self.root}/{table}/{WRITE}={own}"
            if spec.key is None:
                rows.write.option("compression", "zstd").parquet(folder)
                return {0: folder}
            replaced = list(range(self.buckets)) if buckets is None else buckets
            kept = {b: p for b, p in folders.get(table, {}).items() if b not in replaced}
            if replaced:
                laid_out = rows.withColumns({WRITE: F.lit(own), BUCKET: self.bucket_of(F.col(spec.key))})
                if not spec.wide or self.buckets > FILES_OF_A_TASK:
                    # REBALANCE brings a bucket together and splits it again where it is too large for a task.
                    laid_out = laid_out.hint("rebalance", F.col(BUCKET))
                laid_out.select(*self._layout(table)).write.insertInto(self._declare(table, set()))
                self._listed[table].add(own)
                names = [name for name in self._children(folder) if name.startswith(f"{BUCKET}=")]
                kept |= {int(name.split("=")[1]): f"{folder}/{name}" for name in names}
            return kept

        # The tables are written side by side; each write is a Spark job of its own.
        with ThreadPoolExecutor(max_workers=len(changes)) as pool:
            written = list(pool.map(inheritable_thread_target(self.spark)(write), changes))
        folders.update((table, by_bucket) for table, by_bucket in zip(changes, written, strict=True) if not TABLES[table].append_by)
        self._publish(version + 1, folders, appended)
        return version + 1
