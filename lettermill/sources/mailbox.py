"""Message scans and folder state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FOLDER = "INBOX"


def normalize_folders(values: Sequence[str] | None = None, defaults: Sequence[str] | None = None) -> list[str]:
    """Job argument to ordered distinct folder names: request, else setting, else INBOX."""
    for source in (values, defaults):
        names = [name.strip() for value in source or () for name in value.split(",")]
        distinct = list(dict.fromkeys(name for name in names if name))
        if distinct:
            return distinct
    return [DEFAULT_FOLDER]


def folder_selection(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """The requested folders with their order; as long as the argument, hence safe to broadcast."""
    return spark.createDataFrame([(f, i) for i, f in enumerate(folders)], "folder string, folder_ord int")


def folder_order(folder: Column, folders: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in folders]), folder).cast("int") - 1


def _arrival(folders: Sequence[str]) -> Column:
    """Messages come folder by folder in request order, and inside a folder in server order."""
    return F.struct(folder_order(F.col("folder"), folders).alias("folder_ord"), F.col("seq").alias("pos"))


def lookback_start(days: int, today: date | str) -> Column:
    if days < 1:
        raise ValueError("a look-back needs at least one day")
    return F.date_sub(F.lit(today).cast("date"), days)


def scan_lookback(messages: DataFrame, folders: Sequence[str], days: int, today: date | str) -> DataFrame:
    """Messages received in the last ``days`` days. Both predicates reach the file scan; a table partitioned
    by folder is pruned. Such a scan knows no UIDs."""
    wanted = F.col("folder").isin(*folders) & (F.col("received_date") >= lookback_start(days, today))
    return messages.where(wanted).withColumns({"seq": _arrival(folders), "imap_uid": F.lit(None).cast("bigint")})


def scan_uid_range(messages: DataFrame, folder: str, start_uid: int, end_uid: int | None = None) -> DataFrame:
    """Messages of one folder with a UID in the closed range, open at the end if there is none."""
    if start_uid < 1:
        raise ValueError("UIDs start at 1")
    wanted = (F.col("folder") == folder) & (F.col("imap_uid") >= start_uid)
    if end_uid:
        wanted &= F.col("imap_uid") <= end_uid
    return messages.where(wanted)


def folder_status(uids: DataFrame, validity: DataFrame | None = None) -> DataFrame:
    """``(folder, message_count, uidvalidity, uidnext, max_uid)`` from the UIDs on the server.

    ``validity`` (folder, uidvalidity, and uidnext if the server tells it) is one row per folder; a folder that has lost all its
    mail is there with count 0. Without it only folders with mail are known, and the validity is 0.
    """
    status = uids.groupBy("folder").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("uid").alias("max_uid"), (F.max("uid") + 1).alias("uidnext")
    )
    if validity is None:
        status = status.withColumn("uidvalidity", F.lit(0).cast("long"))
    else:
        told = F.col("uidnext").cast("long") if "uidnext" in validity.columns else F.lit(None).cast("long")
        folders = validity.select("folder", "uidvalidity", told.alias("told"))
        status = folders.join(status, "folder", "full").withColumn("uidnext", F.coalesce("told", "uidnext"))
    known = F.coalesce("uidvalidity", F.lit(0)).cast("long")
    count = F.coalesce("message_count", F.lit(0)).cast("long")
    return status.select("folder", count.alias("message_count"), known.alias("uidvalidity"), "uidnext", "max_uid")
