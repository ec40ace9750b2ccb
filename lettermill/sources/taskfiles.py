"""Task exports: files of JSON lines, or of a columnar format, with items of all types in one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.tasks import open_items
from lettermill.plans.snapshot import TaskTables

#: One line for each area, project, heading, to-do and checklist item. ``checklist`` is a flag or the list itself, kept as JSON text;
#: ``todo_uuid`` and ``pos`` are those of checklist items.
EXPORT = (
    "type string, uuid string, title string, status string, trashed boolean, area string, project string, project_title string, "
    "heading string, heading_title string, notes string, start string, checklist string, todo_uuid string, pos long"
)
# The types of an export.
AREA, PROJECT, HEADING, TODO, ITEM = "area", "project", "heading", "to-do", "checklist-item"


def read_export(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """All rows of the files. A line that is no JSON object of the schema fails the job; fields that the schema lacks are ignored."""
    reader = spark.read.schema(EXPORT).format(format)
    return (reader.option("mode", "FAILFAST") if format == "json" else reader).load(path)


def scan_tasks(spark: SparkSession, path: str, kind: str, format: str = "json") -> DataFrame:
    """The open items of one type: incomplete and not trashed.

    Type, status and trashed are compared by the scan itself, which drops a row before it is converted, and in columnar files skips row
    groups. Rows without a status, or that do not say whether they are trashed, are not open. Repeated rows stay.
    """
    return open_items(read_export(spark, path, format), kind)


def task_tables(spark: SparkSession, path: str, format: str = "json") -> TaskTables:
    """The tables of a snapshot, each with its own scan of the export."""

    def of(kind: str, *columns: str) -> DataFrame:
        return read_export(spark, path, format).where(F.col("type") == kind).select(*columns)

    item = ("uuid", "title", "status", "trashed", "notes")
    return TaskTables(
        areas=of(AREA, "uuid", "title"),
        projects=of(PROJECT, *item, "area"),
        headings=of(HEADING, *item, "type", "project", "project_title", "start"),
        todos=of(TODO, *item, "project", "project_title", "area", "heading", "heading_title", "start", "checklist"),
        items=of(ITEM, "uuid", "todo_uuid", "pos", "title", "status"),
    )
