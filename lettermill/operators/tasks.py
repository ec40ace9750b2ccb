"""Task tables: typed projections, open items, checklists, notes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.checks import fail_where
from lettermill.functions.text import is_blank

# Fixed value: the title of a to-do whose own is blank.
UNTITLED_TODO = "(untitled to-do)"


class Checked(NamedTuple):
    ok: DataFrame
    rejected: DataFrame


def open_items(tasks: DataFrame, kind: str | None = None) -> DataFrame:
    """Incomplete and not trashed; of one ``type`` if the table holds several."""
    wanted = (F.col("status") == "incomplete") & ~F.col("trashed")
    if kind is not None:
        wanted &= F.col("type") == kind
    return tasks.where(wanted)


def _typed(entity: DataFrame, columns: dict[str, str], *extra: Column) -> DataFrame:
    """Rename to the stored names; an absent column is null, one that is no string fails the job."""
    for source in columns.values():
        if source in entity.columns and entity.schema[source].dataType.simpleString() not in ("string", "void"):
            raise TypeError(f"column '{source}' holds no strings")
    have = set(entity.columns)
    return entity.select(
        *[(F.col(src) if src in have else F.lit(None)).cast("string").alias(dst) for dst, src in columns.items()], *extra
    )


def require_nonblank(entity: DataFrame, *fields: str, strict: bool = False, name: str = "item") -> Checked:
    """Rows with all ``fields`` filled, and the others with the first missing field; ``strict`` fails the job."""
    missing = F.coalesce(*[F.when(is_blank(F.col(f)), F.lit(f)) for f in fields])
    message = F.concat(F.lit(f"{name} without "), missing)
    rejected = entity.where(missing.isNotNull()).withColumn("reason", message)
    if not strict:
        return Checked(entity.where(missing.isNull()), rejected)
    return Checked(fail_where(entity, missing.isNotNull(), message), rejected)


def todo_title(title: Column) -> Column:
    """A blank title gets a placeholder; a null one stays null and is refused later."""
    return F.when(title.isNotNull() & is_blank(title), F.lit(UNTITLED_TODO)).otherwise(title)


def map_areas(areas: DataFrame) -> DataFrame:
    return _typed(areas, {"uuid": "uuid", "title": "title"})


def map_projects(projects: DataFrame) -> DataFrame:
    return _typed(
        projects, {"uuid": "uuid", "title": "title", "area_uuid": "area", "notes": "notes", "status": "status"}
    )


def map_headings(headings: DataFrame) -> DataFrame:
    return _typed(
        headings,
        {
            "uuid": "uuid", "title": "title", "project_uuid": "project", "project_title": "project_title",
            "notes": "notes", "status": "status", "start_value": "start",
        },
    )


def map_todos(todos: DataFrame) -> DataFrame:
    mapped = _typed(
        todos,
        {
            "uuid": "uuid", "title": "title", "project_uuid": "project", "project_title": "project_title",
            "area_uuid": "area", "heading_uuid": "heading", "heading_title": "heading_title", "notes": "notes",
            "status": "status", "start_value": "start",
        },
    )
    return mapped.withColumn("title", todo_title(F.col("title")))


def map_checklist_items(items: DataFrame) -> DataFrame:
    """Items with their to-do and their place in its list."""
    return _typed(items, {c: c for c in ("uuid", "todo_uuid", "title", "status")}, F.col("pos").cast("long").alias("pos"))


class Inline(NamedTuple):
    todos: DataFrame
    items: DataFrame


def inline_checklists(todos: DataFrame, column: str = "checklist") -> Inline:
    """Take apart a JSON column that is a flag or the list of items itself, as exports have it.

    ``todos`` loses the column and gains ``has_checklist``, which is true where it is the flag ``true``: the items of such a to-do are in
    the item table. ``items`` are those of lists, as (uuid, todo_uuid, title, status, pos) with the place in the list. Null and ``false``
    are no checklist. Anything else, an item that is no object, and a field of an item that is no string fail the job.
    """
    value = F.parse_json(F.col(column))
    kind = F.schema_of_variant(value)
    known = kind.isNull() | kind.isin("BOOLEAN", "VOID") | kind.startswith("ARRAY<")
    sound = fail_where(todos, ~known, F.concat(F.lit("checklist must be a flag or a list: "), F.col(column)))
    flag = F.coalesce(F.when(kind == "BOOLEAN", F.variant_get(value, "$", "boolean")), F.lit(False))
    flagged = sound.withColumn("has_checklist", flag).drop(column)

    # Lists are exploded one by one; no list is gathered.
    elements = F.variant_get(F.when(kind.startswith("ARRAY<"), value), "$", "array<variant>")
    rows = sound.select(F.col("uuid").alias("todo_uuid"), F.posexplode(elements).alias("pos", "item"))
    rows = fail_where(rows, ~F.schema_of_variant("item").startswith("OBJECT<"), F.lit("checklist item must be an object"))
    for name in ("uuid", "title", "status"):
        kind_of = F.schema_of_variant(F.variant_get("item", f"$.{name}", "variant"))
        rows = fail_where(rows, kind_of.isNotNull() & ~kind_of.isin("STRING", "VOID"), F.lit(f"field '{name}' of a checklist item must be a string"))
    fields = [F.variant_get("item", f"$.{name}", "string").alias(name) for name in ("uuid", "title", "status")]
    return Inline(flagged, rows.select(fields[0], "todo_uuid", *fields[1:], F.col("pos").cast("long").alias("pos")))


def checklist_rows(todos: DataFrame, items: DataFrame) -> DataFrame:
    """The items of the open to-dos that say they have a checklist, one row each and never nested.

    One left semi join replaces a detail read per to-do.
    """
    flagged = todos.where("has_checklist").select(F.col("uuid").alias("todo_uuid"))
    return items.join(flagged, "todo_uuid", "left_semi")


def checklist_hydrate(todos: DataFrame, items: DataFrame) -> DataFrame:
    """To-dos with their items: a row for each item, with its place ``pos``, and one with nulls for a to-do without items.

    ``todos`` are mapped to-dos with their ``has_checklist`` flag. The shape is the same for a list of two and of a million
    items: no list is gathered, and the join's item side may be split if one to-do has most of the items.
    """
    return hydrate(todos.drop("has_checklist"), checklist_rows(todos, items))


def hydrate(todos: DataFrame, items: DataFrame) -> DataFrame:
    """To-dos with the given items, see :func:`checklist_hydrate`."""
    rows = items.select(F.col("todo_uuid").alias("uuid"), "pos", F.struct("uuid", "title", "status").alias("checklist_item"))
    return todos.join(rows, "uuid", "left")


def checklist_flatten(hydrated: DataFrame) -> DataFrame:
    """The items back as rows with their to-do."""
    items = hydrated.where(F.col("checklist_item").isNotNull()).select(F.col("uuid").alias("todo_uuid"), "checklist_item")
    return items.select("checklist_item.uuid", "todo_uuid", "checklist_item.title", "checklist_item.status")


def collect_notes(projects: DataFrame, todos: DataFrame) -> DataFrame:
    """The non-blank notes of projects and to-dos, kept verbatim."""

    def notes(items: DataFrame, kind: str) -> DataFrame:
        filled = items.where(~is_blank(F.col("notes")))
        return filled.select(
            F.col("uuid").alias("item_uuid"),
            F.lit(kind).alias("item_type"),
            "title",
            F.col("notes").alias("content"),
            *[c for c in ("project_uuid", "area_uuid") if c in items.columns],
        )

    columns = ["item_uuid", "item_type", "title", "content", "project_uuid", "area_uuid"]
    return notes(projects, "project").unionByName(notes(todos, "to-do"), allowMissingColumns=True).select(*columns)
