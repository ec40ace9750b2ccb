"""Documents without the second copy of their text that the searchable text is.

The searchable text of mail is its title and its body. Written tables hold a mark instead of it; any other searchable text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import blank_to_null

# Fixed value: alone it stands for title and body; a text that begins with it gets another one.
MARK = "\x00"


def _joined(title: str) -> Column:
    return F.concat_ws("\n\n", blank_to_null(F.col(title)), blank_to_null(F.col("body")))


def without_copies(rows: DataFrame, title: str = "title") -> DataFrame:
    """The mark for a searchable text that is title and body; null stays null."""
    text = F.col("searchable_text")
    short = F.when(text == _joined(title), F.lit(MARK)).when(text.startswith(MARK), F.concat(F.lit(MARK), text)).otherwise(text)
    return rows.withColumn("searchable_text", short)


def with_copies(rows: DataFrame, title: str = "title") -> DataFrame:
    """What :func:`without_copies` got."""
    text = F.col("searchable_text")
    whole = F.when(text == MARK, _joined(title)).when(text.startswith(MARK), F.substring(text, 2, 1 << 30)).otherwise(text)
    return rows.withColumn("searchable_text", whole)
