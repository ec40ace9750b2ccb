"""Task tables to a consistent, stored six-table snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators import tasks as ops
from lettermill.sinks.store import TABLES, Store


@dataclass(frozen=True)
class TaskTables:
    """The raw task tables. ``items`` are checklist items with ``todo_uuid`` and ``pos``; to-dos have a flag ``has_checklist``, or a JSON
    column ``checklist`` that is the flag or the items themselves."""

    areas: DataFrame
    projects: DataFrame
    headings: DataFrame
    todos: DataFrame
    items: DataFrame


@dataclass(frozen=True)
class Snapshot:
    areas: DataFrame
    projects: DataFrame
    headings: DataFrame
    todos: DataFrame
    checklist_items: DataFrame
    notes: DataFrame
    nested_todos: DataFrame


def build_snapshot(raw: TaskTables, strict: bool = True) -> Snapshot:
    """Areas, open projects, headings and to-dos, their checklists and notes, lazily."""

    def checked(rows: DataFrame, name: str) -> DataFrame:
        return ops.require_nonblank(rows, "uuid", "title", strict=strict, name=name).ok

    open_todos, inline = ops.open_items(raw.todos), None
    if "checklist" in open_todos.columns:
        open_todos, inline = ops.inline_checklists(open_todos)
    projects = checked(ops.map_projects(ops.open_items(raw.projects)), "project")
    todos = checked(ops.map_todos(open_todos), "to-do")
    items = ops.map_checklist_items(raw.items)
    flagged = open_todos.select("uuid", "has_checklist")
    listed = ops.checklist_rows(flagged, items)
    if inline is not None:
        listed = listed.unionByName(inline)
    rows = checked(listed, "checklist item")
    nested = ops.hydrate(todos, rows)
    return Snapshot(
        areas=checked(ops.map_areas(raw.areas), "area"),
        projects=projects,
        headings=checked(ops.map_headings(ops.open_items(raw.headings, "heading")), "heading"),
        todos=todos,
        checklist_items=rows.select("uuid", "todo_uuid", "title", "status", "pos"),
        notes=ops.collect_notes(projects, todos),
        nested_todos=nested,
    )


def replace_snapshot(store: Store, snapshot: Snapshot, now: datetime | str) -> int:
    """Write all six tables anew and publish them together; readers see the old or the new snapshot."""
    stamp = F.lit(now).cast("timestamp")
    slices = {
        "task_areas": snapshot.areas,
        "task_projects": snapshot.projects,
        "task_headings": snapshot.headings,
        "task_todos": snapshot.todos,
        "task_checklist_items": snapshot.checklist_items,
        "task_notes": snapshot.notes,
    }
    stamped = {name: rows.withColumns({"created_at": stamp, "updated_at": stamp}) for name, rows in slices.items()}
    return store.commit({name: (rows.select(*TABLES[name].schema.names), None) for name, rows in stamped.items()})


def snapshot_json(snapshot: Snapshot) -> DataFrame:
    """``(slice, json)``: one JSON object per row with sorted keys and explicit nulls.

    The whole snapshot as one object would have to pass through one task; as lines it is written in
    parallel, for instance with ``.write.partitionBy("slice").text(path)``. Checklist items are a slice of their own, with the
    to-do and the place in its list, whatever its length.
    """
    slices = {
        "areas": snapshot.areas,
        "projects": snapshot.projects,
        "headings": snapshot.headings.withColumnRenamed("start_value", "start"),
        "todos": snapshot.todos.withColumnRenamed("start_value", "start"),
        "checklist_items": snapshot.checklist_items,
        "notes": snapshot.notes,
    }
    parts = []
    for name, rows in slices.items():
        text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        parts.append(rows.select(F.lit(name).alias("slice"), text.alias("json")))
    first, *others = parts
    for part in others:
        first = first.unionByName(part)
    return first
