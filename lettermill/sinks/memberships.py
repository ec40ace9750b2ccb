"""The folders of documents as rows of a narrow table, and back as the list and maps of their metadata.

A run that only takes documents out of folders rewrites these rows, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import schemas

_MAPS = {"folder_uids": "uid", "folder_flags": "flags", "folder_keywords": "keywords"}
_KINDS = {"folders": schemas.STRINGS, "folder_uids": schemas.UID_MAP, "folder_flags": schemas.TERM_MAP, "folder_keywords": schemas.TERM_MAP}


def memberships_of(documents: DataFrame) -> DataFrame:
    """(document_key, folder, ord, uid, flags, keywords): a row for each folder that a document's list or maps name.

    ``ord`` is the place in the list, null for a folder that only a map names. A null value in a map is as if it were absent.
    """
    m = F.col("metadata")
    listed = F.coalesce(m["folders"], F.array().cast("array<string>"))
    named = [F.coalesce(F.map_keys(m[name]), F.array().cast("array<string>")) for name in _MAPS]
    folders = F.array_distinct(F.concat(listed, *named))
    rows = documents.select("document_key", F.explode(folders).alias("folder"), listed.alias("_listed"), *[m[n].alias(n) for n in _MAPS])
    place = F.array_position("_listed", F.col("folder"))
    return rows.select(
        "document_key",
        "folder",
        F.when(place > 0, (place - 1).cast("int")).alias("ord"),
        *[F.try_element_at(name, F.col("folder")).alias(column) for name, column in _MAPS.items()],
    )


def without_memberships(documents: DataFrame) -> DataFrame:
    """Documents whose folder list and maps are empty, or null where they were."""
    m = F.col("metadata")
    stripped = m
    for name, kind in _KINDS.items():
        empty = (F.array() if name == "folders" else F.create_map()).cast(kind)
        stripped = stripped.withField(name, F.when(m[name].isNotNull(), empty))
    return documents.withColumn("metadata", F.when(m.isNotNull(), stripped))


def folded(memberships: DataFrame) -> DataFrame:
    """(document_key, folders, folder_uids, folder_flags, folder_keywords): at most one entry for each folder of a document."""
    entry = F.struct(F.col("ord").isNull().alias("unlisted"), "ord", "folder", "uid", "flags", "keywords")
    entries = memberships.groupBy("document_key").agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def as_map(column: str) -> Column:
        kept = F.filter("entries", lambda e: e[column].isNotNull())
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["folder"], e[column])))

    listed = F.transform(F.filter("entries", lambda e: ~e["unlisted"]), lambda e: e["folder"])
    return entries.select("document_key", listed.alias("folders"), *[as_map(column).alias(name) for name, column in _MAPS.items()])


def with_memberships(documents: DataFrame, memberships: DataFrame) -> DataFrame:
    """Stored documents with their folders in the metadata."""
    rows, found = documents.alias("d"), folded(memberships).alias("f")
    m = F.col("d.metadata")
    filled = m
    for name in _KINDS:
        filled = filled.withField(name, F.coalesce(F.col(f"f.{name}"), m[name]))
    joined = rows.join(found, F.col("d.document_key") == F.col("f.document_key"), "left")
    own = {"metadata": F.when(m.isNotNull(), filled).alias("metadata")}
    return joined.select(*[own.get(c, F.col(f"d.{c}")) for c in documents.columns])


def replace_memberships(stored: DataFrame, batch: DataFrame, missing: DataFrame) -> DataFrame:
    """Memberships after a run: those of the ``batch`` documents replace stored ones of the same keys, then ``missing``
    (document_key, folder) go. No text is read."""
    kept = stored.join(batch.select("document_key"), "document_key", "left_anti").unionByName(memberships_of(batch))
    return kept.join(missing.select("document_key", "folder").distinct(), ["document_key", "folder"], "left_anti")
