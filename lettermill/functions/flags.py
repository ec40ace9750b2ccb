"""Flag, keyword and recipient expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import collapse_whitespace, nonblank_array

# The mailbox protocol's system flags.
SYSTEM_FLAGS = ("\\Answered", "\\Deleted", "\\Draft", "\\Flagged", "\\Recent", "\\Seen")


# Fixed value: where a fetch descriptor lists the flags.
FLAG_GROUP = r"FLAGS \(([^)]*)\)"


def parse_flags(descriptor: Column) -> Column:
    """Ordered distinct flags of the first ``FLAGS (...)`` group; empty when there is none."""
    inner = F.regexp_extract(descriptor, FLAG_GROUP, 1)
    return F.array_distinct(nonblank_array(F.split(collapse_whitespace(inner), " ")))


def keywords_of(flags: Column) -> Column:
    """The flags a user defined: no system flag and no leading backslash."""
    return F.filter(flags, lambda f: ~f.isin(*SYSTEM_FLAGS) & ~f.startswith("\\"))


def is_system_flag(term: Column) -> Column:
    return F.left(term, F.lit(1)) == "\\"


def split_recipients(header: Column) -> Column:
    """Comma-separated addresses, trimmed; null when none is left."""
    parts = nonblank_array(F.transform(F.split(header, ","), collapse_edges))
    return F.when(F.size(parts) > 0, parts)


def collapse_edges(text: Column) -> Column:
    """Trim any whitespace at both ends, keeping the inside."""
    return F.regexp_replace(text, r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$", "")


def build_recipients(to: Column, cc: Column, bcc: Column, reply_to: Column) -> Column:
    """All addressees in header order, not de-duplicated."""
    return F.concat(*[nonblank_array(group) for group in (to, cc, bcc, reply_to)])
