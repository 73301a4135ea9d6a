"""Session queries and answer texts on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from planframe.functions import answers
from planframe.operators import session


def test_scan_limit_holds_before_boxes_are_asked_for(spark):
    rows = [(i, "Walls" if i % 2 else "Doors", None if i < 6 else "box") for i in range(20)]
    df = spark.createDataFrame(rows, "element_id long, category string, bbox string")
    got = session.query_elements(df, "Walls", scanned=5).collect()
    assert [r.element_id for r in got] == [7, 9] and all(r.truncated for r in got)
    assert [r.element_id for r in session.query_elements(df, ids=[8, 2]).collect()] == [8]


def test_families_and_manifest(spark):
    df = spark.createDataFrame([("k", "F", "b"), ("k", "F", "a"), ("k", "F", "a"), ("j", "G", "z"), ("j", "H", None)], "kind string, family_name string, type_name string")
    assert {r.family_name: r.types for r in session.families(df).collect()} == {"F": ["a", "b"], "G": ["z"]}
    assert [r.entry for r in session.manifest(df.where("type_name is not null")).collect()] == ["G::z", "F::a", "F::b"]


def test_training_plan(spark):
    c = spark.createDataFrame([(1, 1, "column", -5.0, 0.0, 10.0, 10.0, False), (2, 1, "tree", 0.0, 0.0, 9.0, 9.0, False), (3, 1, "column", 0.0, 0.0, 9.0, 9.0, True), (4, 1, "column", None, 0.0, 9.0, 9.0, False), (5, 2, "column", 0.0, 0.0, 9.0, 9.0, False), (6, 1, "column", 500.0, 0.0, 600.0, 9.0, False)], "id long, job_id long, element_type string, x1 double, y1 double, x2 double, y2 double, is_delete boolean")
    r = spark.createDataFrame([(1, 100.0, 100.0)], "job_id long, width_px double, height_px double")
    got = {x.id: (x.label, x.status) for x in session.training_plan(c, r, {"column": 0, "beam": 1}).collect()}
    assert got == {1: ("0 0.5 0.5 1.0 1.0", "written"), 2: ("# tree", "written"), 3: ("", "written"), 4: (None, "no box"), 5: (None, "no render"), 6: (None, "empty box")}


def test_schedule_pages_and_enrichment(spark):
    t = spark.createDataFrame([(1, 0, "C1 300x300"), (1, 0, "C2 Ø300"), (1, 0, "C3 400x400"), (1, 1, "C1"), (1, 1, "300x300")], "job_id long, page_idx int, text string")
    assert {r.page_idx: r.is_schedule for r in session.schedule_pages(t).collect()} == {0: True, 1: False}
    e = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "job_id long, ord long")
    m = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")], "job_id long, ord long, mark string")
    assert {(r.job_id, r.ord): r.mark for r in session.enrich(e, m, ["mark"]).collect()} == {(1, 0): "a", (1, 1): "b", (2, 0): None}


REPAIRS = [
    ('```json\n{"a": [1, 2,], // note\n "b": 3,}\n```', {"a": [1, 2], "b": 3}),
    ('{"a": 1 # one\n, "b": "x # y // z", "u": "http://h/p"}', {"a": 1, "b": "x # y // z", "u": "http://h/p"}),
    ('{"a": 1\n "b": "two"\n "c": {"d": null}\n "e": [1\n 2\n "x"]\n}', {"a": 1, "b": "two", "c": {"d": None}, "e": [1, 2, "x"]}),
    ('[ {"a": 1} ]', {"a": 1}),
    ('[{"a": 1}, {"a": 2}]', [{"a": 1}, {"a": 2}]),
    ('[1]', [1]),
    ('Sure, here it is: {"a": undefined, "b": NaN, "c": -Infinity, "d": Infinity} Anything else?', {"a": None, "b": None, "c": None, "d": None}),
    ('{"a": "undefined"}', {"a": "undefined"}),
    ('{"a": [1, {"b": "x', {"a": [1, {"b": "x"}]}),
    ('{"columns": [{"id": 1}, {"id": 2, "na', {"columns": [{"id": 1}]}),
    ('{"a": {"x": 1}, "b": {"y": 2', {"a": {"x": 1}}),
    ('{"a": [1, 2', {"a": [1, 2]}),
    ('{"a": [1, 2,', {"a": [1, 2]}),
    ('{"a": [1, 2]]}', {"a": [1, 2]}),
    ('{"a": "b\\"c", "d": "e\\\\"}', {"a": 'b"c', "d": "e\\"}),
    ('{"a": "cut \\', {"a": "cut \\"}),
    ("no json here", None),
    ("", None),
    ('{"a" 1}', None),
    ('{"a": tru}', None),
    ('{"a": 1 "b": 2}', None),
]


@pytest.mark.parametrize(("text", "want"), REPAIRS)
def test_repairs(text, want):
    got = answers.repaired(text)
    assert (None if got is None else json.loads(got)) == want


def test_a_long_answer_is_one_pass():
    n = 20_000
    text = "{\n" + "\n".join(f'"k{i}": [{i}, "# {i}"] // c' for i in range(n)) + "\n}"
    assert len(json.loads(answers.repaired(text))) == n
    assert json.loads(answers.repaired("[" * 500 + "1"))


def test_answers(spark):
    cut = spark.createDataFrame([('{"a": [1, 2',), (None,)], "t string").select(answers.repair_json("t").alias("r")).collect()
    assert [r.r for r in cut] == ['{"a":[1,2]}', None]
    n = spark.createDataFrame([("800 mm", 800.0), ("1,200", 1200.0), ("none", None)], "t string, want double")
    assert all(r.got == r.want for r in n.select(answers.number(F.col("t")).alias("got"), "want").collect())
    s = spark.createDataFrame([("Plan A (1).pdf", "Plan_A_1"), ("___", "model"), ("naïve.pdf", "naïve")], "t string, want string")
    assert all(r.got == r.want for r in s.select(answers.stem(F.col("t")).alias("got"), "want").collect())
    h = spark.createDataFrame([('[{"text":"a","element_ids":[1]}]',), ('["b"]',)], "h string")
    got = [[(w.text, w.element_ids) for w in r.w] for r in h.select(answers.warnings(F.col("h")).alias("w")).collect()]
    assert got == [[("a", [1])], [("b", [])]]
