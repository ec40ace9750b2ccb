import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lettermill.operators import digest as D
from lettermill.operators import tasks as K
from lettermill.plans import snapshot as H

TODO = "uuid string, title string, project string, heading string, notes string, status string, trashed boolean, has_checklist boolean, start string"


def tables(spark):
    return H.TaskTables(
        areas=spark.createDataFrame([("area-1", "Family")], "uuid string, title string"),
        projects=spark.createDataFrame(
            [("project-1", "Trip", "area-1", "Book it", "incomplete", False), ("project-2", "Old", None, None, "completed", False),
             ("project-3", "Bin", None, "x", "incomplete", True), ("project-4", "Blank", "area-1", "  ", "incomplete", False)],
            "uuid string, title string, area string, notes string, status string, trashed boolean",
        ),
        headings=spark.createDataFrame(
            [("heading-1", "Prep", "project-1", "Trip", None, "incomplete", "Anytime", False, "heading"), ("x", "No", None, None, None, "incomplete", None, False, "to-do")],
            "uuid string, title string, project string, project_title string, notes string, status string, start string, trashed boolean, type string",
        ),
        todos=spark.createDataFrame(
            [("todo-1", "Pack", "project-1", "heading-1", "\n keep me ", "incomplete", False, True, "Someday"), ("todo-2", "  ", None, None, "", "incomplete", False, False, None),
             ("todo-3", "Done", None, None, "n", "completed", False, True, None), ("todo-4", "Flag only", None, None, None, "incomplete", False, True, None)],
            TODO,
        ),
        items=spark.createDataFrame(
            [("c-2", "todo-1", 1, "Shoes", "completed"), ("c-1", "todo-1", 0, "Passport", "incomplete"), ("c-3", "todo-3", 0, "No", "incomplete"), ("c-4", "todo-2", 0, "Not flagged", None)],
            "uuid string, todo_uuid string, pos int, title string, status string",
        ),
    )


def test_snapshot(spark, store):
    s = H.build_snapshot(tables(spark))
    assert [r.uuid for r in s.projects.orderBy("uuid").collect()] == ["project-1", "project-4"]
    assert [(r.uuid, r.start_value) for r in s.headings.collect()] == [("heading-1", "Anytime")]
    assert {r.uuid: r.title for r in s.todos.collect()} == {"todo-1": "Pack", "todo-2": "(untitled to-do)", "todo-4": "Flag only"}
    assert sorted((r.uuid, r.todo_uuid) for r in s.checklist_items.collect()) == [("c-1", "todo-1"), ("c-2", "todo-1")]
    nested = sorted((r.uuid, r.pos or 0, r.checklist_item and r.checklist_item.title) for r in s.nested_todos.collect())
    assert [(u, t) for u, _, t in nested] == [("todo-1", "Passport"), ("todo-1", "Shoes"), ("todo-2", None), ("todo-4", None)]
    notes = sorted((r.item_uuid, r.item_type, r.content, r.project_uuid, r.area_uuid) for r in s.notes.collect())
    assert notes == [("project-1", "project", "Book it", None, "area-1"), ("todo-1", "to-do", "\n keep me ", "project-1", None)]
    assert H.replace_snapshot(store, s, "2026-04-01 00:00:00") == 1
    assert store.read("task_todos").count() == 3
    H.replace_snapshot(store, H.build_snapshot(H.TaskTables(**{**tables(spark).__dict__, "todos": tables(spark).todos.limit(1)})), "2026-04-02 00:00:00")
    assert (store.version(), store.read("task_todos").count(), store.read("task_areas").count()) == (2, 1, 1)


def test_snapshot_json(spark):
    rows = [(r.slice, json.loads(r.json)) for r in H.snapshot_json(H.build_snapshot(tables(spark))).collect()]
    todo = next(j for s, j in rows if s == "todos" and j["uuid"] == "todo-1")
    items = sorted((j["pos"], j["uuid"], j["title"], j["status"]) for s, j in rows if s == "checklist_items" and j["todo_uuid"] == "todo-1")
    assert [i[1:] for i in items] == [("c-1", "Passport", "incomplete"), ("c-2", "Shoes", "completed")]
    assert list(todo) == sorted(todo) and todo["area_uuid"] is None and todo["start"] == "Someday"
    assert ("areas", {"title": "Family", "uuid": "area-1"}) in rows


@pytest.mark.parametrize("places", [[0, 1], [999, 1000], list(range(5_000))])
def test_checklist_has_one_shape_at_every_length(spark, places):
    todos = spark.createDataFrame([("t", True), ("u", True)], "uuid string, has_checklist boolean")
    items = spark.createDataFrame([(f"i{p}", "t", p, "x", None) for p in places], "uuid string, todo_uuid string, pos long, title string, status string")
    rows = K.checklist_hydrate(todos, items)
    found = sorted((r.uuid, r.pos, r.checklist_item.uuid) for r in rows.where("pos is not null").collect())
    assert found == [("t", p, f"i{p}") for p in places]
    assert [tuple(r) for r in rows.where("pos is null").collect()] == [("u", None, None)]
    assert K.checklist_flatten(rows).count() == len(places)


def test_required_fields_and_types(spark):
    bad = spark.createDataFrame([("a", " "), (None, "b"), ("c", "d")], "uuid string, title string")
    checked = K.require_nonblank(bad, "uuid", "title", name="area")
    assert [r.uuid for r in checked.ok.collect()] == ["c"]
    assert sorted(r.reason for r in checked.rejected.collect()) == ["area without title", "area without uuid"]
    with pytest.raises(Exception, match="item without"):
        K.require_nonblank(bad, "uuid", "title", strict=True).ok.count()
    with pytest.raises(TypeError):
        K.map_areas(spark.createDataFrame([(1, "x")], "uuid int, title string"))
    null_title = spark.createDataFrame([("t", None)], "uuid string, title string")
    with pytest.raises(Exception, match="without title"):
        K.require_nonblank(K.map_todos(null_title), "uuid", "title", strict=True).ok.collect()


def test_digest(spark):
    items = spark.createDataFrame(
        [("robert", 0, "One"), ("robert", 1, "  "), ("robert", 2, " Two "), (" ", 0, "Default"), ("mARY ann", 0, None), ("mARY ann", 1, "X")],
        "audience string, ord int, item string",
    )
    got = {}
    for r in D.digest_build(items).orderBy("audience", "line_no").collect():
        got.setdefault(r.audience, []).append((r.line_no, r.line))
    assert got["mARY ann"] == [(1, "## Daily Digest for Mary ann"), (2, ""), (3, "- X")]
    # A blank audience is the default one; both lists then are one audience.
    assert got["robert"][:2] == [(1, "## Daily Digest for Robert"), (2, "")] and len(got["robert"]) == 5


@pytest.mark.parametrize("places", [[0, 1], [999, 1000], list(range(3_000))])
def test_digest_has_one_shape_at_every_length(spark, places):
    items = spark.createDataFrame([("bo", p, str(p)) for p in places] + [("al", 7, "one")], "audience string, ord long, item string").repartition(4)
    rows = D.digest_build(items).where("audience = 'bo'").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == list(enumerate(["## Daily Digest for Bo", "", *[f"- {p}" for p in places]], start=1))


def test_digest_lines(spark):
    items = spark.createDataFrame([("bo", 2, "b"), ("bo", 1, "a"), ("bo", 3, " ")], "audience string, ord int, item string")
    lines = D.digest_lines(items, ["ord"]).orderBy("audience", "section", "ord").collect()
    assert [r.line for r in lines] == ["## Daily Digest for Bo", "", "- a", "- b"]


def test_structured_items(spark):
    df = spark.createDataFrame([("plain", None), (None, " s "), (None, None)], "t string, s string")
    got = [r[0] for r in df.select(D.digest_item(F.col("t"), F.col("s"))).collect()]
    assert got == ["plain", "s", None]


def exported(spark, *checklists):
    rows = [(f"todo-{i}", "T", "incomplete", False, c) for i, c in enumerate(checklists)]
    return spark.createDataFrame(rows, "uuid string, title string, status string, trashed boolean, checklist string")


def test_checklists_inside_the_export(spark):
    raw = replace(tables(spark), todos=exported(
        spark, '[{"uuid": "a", "title": "One", "status": null}, {"uuid": "b", "title": "Two", "more": 1}]', "true", "false", None, "null", "[]",
    ))
    raw = replace(raw, items=raw.items.unionByName(spark.createDataFrame([("z", "todo-0", 0, "not asked", None)], raw.items.schema)))
    s = H.build_snapshot(raw)
    found = sorted((r.uuid, r.pos, r.checklist_item and tuple(r.checklist_item)) for r in s.nested_todos.collect() if r.pos is not None)
    assert found == [
        ("todo-0", 0, ("a", "One", None)), ("todo-0", 1, ("b", "Two", None)), ("todo-1", 0, ("c-1", "Passport", "incomplete")), ("todo-1", 1, ("c-2", "Shoes", "completed")),
    ]
    assert s.nested_todos.count() == 8 and s.checklist_items.count() == 4


@pytest.mark.parametrize(
    ("checklist", "message"),
    [
        ('"yes"', "flag or a list"), ("3", "flag or a list"), ('{"uuid": "a"}', "flag or a list"), ('["a"]', "must be an object"),
        ('[{"uuid": 3, "title": "t"}]', "must be a string"), ('[{"uuid": "a", "title": " "}]', "without title"), ('[{"title": "t"}]', "without uuid"),
        ('[{"uuid": "a", "title": "t", "status": true}]', "must be a string"),
    ],
)
def test_checklists_of_another_shape_fail(spark, checklist, message):
    with pytest.raises(Exception, match=message):
        H.build_snapshot(replace(tables(spark), todos=exported(spark, checklist))).nested_todos.collect()
