"""Documents whose metadata is JSON text, as a relational store exports them, to typed rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill import schemas
from lettermill.functions.dates import iso_to_timestamp

_AS_TEXT = {"sent_at": T.StringType(), "folder_uids": T.MapType(T.StringType(), T.StringType())}
_JSON_METADATA = T.StructType(
    [
        T.StructField(f.name, _AS_TEXT.get(f.name, f.dataType))
        for f in schemas.METADATA.fields
        if f.name != "sent_at_iso"
    ]
)


def documents_from_json(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Parse the metadata once, against its fixed schema; afterwards columns are pruned and filters pushed
    as usual. Absent keys become null, which the reports treat like empty ones. The instant of ``sent_at``
    is cast here, text that is no instant becomes null. UIDs are cast one by one; one that is no number goes, the others stay."""
    parsed = rows.withColumn("_m", F.from_json(metadata, _JSON_METADATA))
    numbers = F.transform_values("_m.folder_uids", lambda _, v: v.try_cast("bigint"))
    uids = F.map_filter(numbers, lambda _, v: v.isNotNull())
    fields = [
        iso_to_timestamp(F.col("_m.sent_at")).alias("sent_at")
        if f.name == "sent_at"
        else F.col("_m.sent_at").alias("sent_at_iso")
        if f.name == "sent_at_iso"
        else uids.alias("folder_uids")
        if f.name == "folder_uids"
        else F.col(f"_m.{f.name}").alias(f.name)
        for f in schemas.METADATA.fields
    ]
    return parsed.withColumn(metadata, F.struct(*fields)).drop("_m")


def documents_to_json(documents: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The reverse: metadata as JSON text with ``sent_at`` in the header's own zone."""
    m = F.col(metadata)
    fields = [
        m["sent_at_iso"].alias("sent_at") if f.name == "sent_at" else m[f.name].alias(f.name)
        for f in schemas.METADATA.fields
        if f.name != "sent_at_iso"
    ]
    return documents.withColumn(metadata, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
