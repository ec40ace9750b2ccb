"""Mail date headers to instants."""

from __future__ import annotations

from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

# Zone names of mail date headers with their offset.
ZONE_OFFSETS = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

# The shapes handled inside the JVM; everything else takes the library parser below.
_COMMON_DATE = (
    r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) "
    r"([1-9]\d{3}) (\d{1,2}):(\d{2})(?::(\d{2}))? ([+-](?:[01]\d|2[0-3])[0-5]\d|"
    + "|".join(ZONE_OFFSETS)
    + r")(?: \([A-Za-z ]*\))?\z"
)


def common_date_fields(raw: Column) -> Column:
    """``[day, month name, year, hour, minute, second, zone]`` of the usual header shapes, null for others.

    Store it as a column before :func:`parse_common_date` takes it apart, so that a row is matched once.
    """
    fields = F.split(F.regexp_replace(raw, _COMMON_DATE, "$1|$2|$3|$4|$5|0$6|$7"), r"\|")
    return F.when(raw.rlike(_COMMON_DATE), fields)


def parse_common_date(part: Column) -> Column:
    """``struct<local timestamp, offset string>`` from the fields; null without fields or for an impossible date."""
    number = lambda i: part[i].cast("int")
    month = ((F.position(part[1], F.lit(_MONTHS)) + 2) / 3).cast("int")
    local = F.try_make_timestamp(number(2), month, number(0), number(3), number(4), number(5), F.lit("UTC"))
    zones = F.create_map(*[F.lit(v) for pair in ZONE_OFFSETS.items() for v in pair])
    offset = F.coalesce(F.try_element_at(zones, part[6]), part[6])
    return F.when((number(5) < 60) & local.isNotNull(), F.struct(local.alias("local"), offset.alias("offset")))


@pandas_udf(T.StringType())
def library_iso(raws: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Any header the standard library can parse."""

    def one(raw: str | None) -> str | None:
        if not raw:
            return None
        try:
            parsed = parsedate_to_datetime(raw)
        except (TypeError, ValueError, IndexError):
            return None
        return parsed.isoformat() + ("Z" if parsed.tzinfo is None else "")

    for raw in raws:
        yield raw.map(one, na_action="ignore").astype(object)


def sent_at_iso(raw: Column, parsed: Column, rare_forms: bool) -> Column:
    """ISO text of the header date; ``Z`` when the header states no usable zone.

    ``parsed`` is the column of :func:`parse_common_date`. Only rows it left null reach Python.
    """
    offset = parsed["offset"]
    suffix = F.when(offset == "-0000", F.lit("Z")).otherwise(F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2)))
    common = F.concat(F.date_format(parsed["local"], "yyyy-MM-dd'T'HH:mm:ss"), suffix)
    if not rare_forms:
        return common
    return F.coalesce(common, library_iso(F.when(parsed.isNull() & (raw != ""), raw)))


def iso_to_timestamp(iso: Column) -> Column:
    return iso.try_cast("timestamp")
