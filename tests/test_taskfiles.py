"""Task exports as files."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from lettermill.catalog import fixtures as X
from lettermill.catalog.queries import _exported
from lettermill.plans import snapshot as H
from lettermill.session import fresh_dir
from lettermill.sources.taskfiles import EXPORT, read_export, scan_tasks, task_tables

LINES = [
    '{"type": "area", "uuid": "a", "title": "Home"}',
    '{"type": "project", "uuid": "p", "title": "Paint", "area": "a", "status": "incomplete", "trashed": false, "notes": "blue"}',
    '{"type": "to-do", "uuid": "t1", "title": "Buy", "status": "incomplete", "trashed": false, "checklist": [{"uuid": "i1", "title": "Brush", "status": "incomplete"}]}',
    '{"type": "to-do", "uuid": "t2", "title": "Mix", "status": "incomplete", "trashed": false, "checklist": true, "unknown": {"x": 1}}',
    '{"type": "to-do", "uuid": "t3", "title": "Old", "status": "completed", "trashed": false, "checklist": true}',
    '{"type": "to-do", "uuid": "t4", "title": "Bin", "status": "incomplete", "trashed": true}',
    '{"type": "to-do", "uuid": "t5", "title": "Odd", "trashed": false}',
    '{"type": "to-do", "uuid": "t6", "title": "Odd", "status": "incomplete"}',
    '{"type": "heading", "uuid": "h", "title": "First", "status": "incomplete", "trashed": false, "project": "p"}',
    '{"type": "checklist-item", "uuid": "i2", "title": "Stir", "status": "incomplete", "todo_uuid": "t2", "pos": 0}',
    '{"type": "checklist-item", "uuid": "i3", "title": "Not asked", "status": "incomplete", "todo_uuid": "t3", "pos": 0}',
]


def export(spark, lines):
    path = fresh_dir(spark, "export")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_open_items_are_chosen_by_the_scan(spark, format):
    path = export(spark, LINES)
    if format == "parquet":
        columnar = fresh_dir(spark, "export")
        read_export(spark, path).write.parquet(columnar)
        path = columnar
    todos = scan_tasks(spark, path, "to-do", format)
    assert sorted(r.uuid for r in todos.collect()) == ["t1", "t2"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = scan_tasks(spark, path, "to-do", format)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert all(x in pushed for x in ("EqualTo(status,incomplete)", "EqualTo(type,to-do)", "Not(EqualTo(trashed,true))")), pushed


def test_snapshot_of_an_export(spark):
    s = H.build_snapshot(task_tables(spark, export(spark, LINES)))
    assert sorted((r.uuid, r.todo_uuid, r.pos) for r in s.checklist_items.collect()) == [("i1", "t1", 0), ("i2", "t2", 0)]
    assert [r.uuid for r in s.areas.collect()] == ["a"] and [r.project_uuid for r in s.headings.collect()] == ["p"]
    assert [(r.item_uuid, r.content) for r in s.notes.collect()] == [("p", "blue")]


def test_repeated_and_broken_lines(spark):
    assert scan_tasks(spark, export(spark, [LINES[2]] * 3), "to-do").count() == 3
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed|FAILFAST"):
        scan_tasks(spark, export(spark, [*LINES, '{"type": "to-do", ']), "to-do").collect()
    empty = fresh_dir(spark, "export")
    spark.createDataFrame([], EXPORT).write.json(empty)
    assert scan_tasks(spark, empty, "to-do").count() == 0
    assert read_export(spark, empty).where(F.col("type") == "area").count() == 0


def test_exports_shuffle_and_write_no_more_than_they_need(spark, tmp_path):
    """Only lines that go into a list are shuffled, as they are in the tables, and the file is compressed; repeated and null keys stay."""
    orders = [(3, 7, "1-URGENT", 10.5, "O"), (3, 7, "1-URGENT", 10.5, "O"), (4, 8, "2-HIGH", 2.0, "F"), (5, None, None, 1.0, "P"), (None, 9, "2-HIGH", 3.0, "O"), (9, 7, "1-URGENT", 4.0, "O")]
    lines = [(3, 2, 70, 1, "F"), (3, 1, 71, None, "O"), (3, 1, 71, None, "O"), (4, 1, 72, 2, "F"), (None, 1, 73, 3, "F"), (6, 1, 74, 4, "O")]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderstatus string"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string"),
        "region": ([(0, "A")], "r_regionkey long, r_name string"),
        "nation": ([(0, 0)], "n_nationkey long, n_regionkey long"),
        "customer": ([(7, 0, "C", "M", 1.0)], "c_custkey long, c_nationkey long, c_name string, c_mktsegment string, c_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    todos = X.task_todos_with_lists(spark, str(tmp_path))
    plan = todos._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "Part " in plan and "Part " not in joined and "todo-" not in joined and joined.count("% 3) = 0") >= 2
    three = [
        {"uuid": "check-3-1-71", "title": "Part 71", "status": "incomplete"}, {"uuid": "check-3-1-71", "title": "Part 71", "status": "incomplete"},
        {"uuid": "check-3-2-70-1", "title": "Part 70", "status": "completed"},
    ]
    got = [(r.uuid, json.loads(r.checklist) if r.checklist else None) for r in todos.collect()]
    wanted = [("todo-3", three), ("todo-3", three), ("todo-4", True), ("todo-5", False), (None, None), ("todo-9", None)]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    headings = sorted(((r.uuid, r.title, r.project) for r in X.task_headings(spark, str(tmp_path)).collect()), key=str)
    assert headings == sorted([("heading-7-1", "1-URGENT", "project-7"), ("heading-8-2", "2-HIGH", "project-8"), (None, None, None), ("heading-9-2", "2-HIGH", "project-9")], key=str)
    path = _exported(spark, str(tmp_path))
    names = [f.name for f in pathlib.Path(path).iterdir() if f.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert read_export(spark, path).groupBy("type").count().collect() and read_export(spark, path).where("type = 'checklist-item'").count() == len(lines)
