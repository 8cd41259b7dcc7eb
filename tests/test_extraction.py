"""The cascade on literal answers: value, deciding stage and validity."""

import json

import pytest
from pyspark.sql import functions as F

from tallywise.functions.extraction import extract_structured, isolate_block, predictions_wide, repair_truncated
from tallywise.functions.json5 import MARK, to_json
from tallywise.functions.schemas import Field, get_schema, json_schema, violations

SCORES = [
    # strict JSON and the lax conversions
    ('{"mRS": 3}', 3, "direct", True),
    (' \n{"mRS": 3.0}\t', 3, "direct", True),
    (' {"mRS": 3} ', 3, "direct", True),
    ('{"mRS": "3"}', 3, "direct", True),
    ('{"mRS": " 3 "}', 3, "direct", True),
    ('{"mRS": "3.0"}', 3, "direct", True),
    ('{"mRS": "+3"}', 3, "direct", True),
    ('{"mRS": "03"}', 3, "direct", True),
    ('{"mRS": 1e0}', 1, "direct", True),
    ('{"mRS": true}', 1, "direct", True),
    ('{"mRS": false}', 0, "direct", True),
    ("{}", -1, "direct", True),
    ('{"other": {"mRS": [1]}}', -1, "direct", True),
    ('{"mRS": 3, "x": {"y": [1, "}"]}}', 3, "direct", True),
    ('{"mRS": 3, "mRS": 4}', 4, "direct", True),
    ('{"mRS": 9, "mRS": 4}', 4, "direct", True),
    # refused values
    ('{"mRS": "true"}', -1, "default", False),
    ('{"mRS": "1e0"}', -1, "default", False),
    ('{"mRS": "5."}', -1, "default", False),
    ('{"mRS": ""}', -1, "default", False),
    ('{"mRS": "three"}', -1, "default", False),
    ('{"mRS": null}', -1, "default", False),
    ('{"mRS": 2.5}', -1, "default", False),
    ('{"mRS": [3]}', -1, "default", False),
    ('{"mRS": {"v": 3}}', -1, "default", False),
    ('{"mRS": NaN}', -1, "default", False),
    ('{"mRS": 7}', 7, "field_regex", False),
    ('{"mRS": -1}', -1, "field_regex", False),
    ('{"mRS": -5}', -5, "field_regex", False),
    ('{"mRS": 99999999999999999999}', -1, "field_regex", False),
    ('{"mRS": 4, "mRS": 9}', 4, "field_regex", True),
    ('{"mRS": 1e1}', 1, "field_regex", True),
    # isolated block
    ('```json\n{"mRS": 2}\n```', 2, "isolated", True),
    ('so ``` {"mRS": 2} ``` ok', 2, "isolated", True),
    ('Score: {"mRS": 5}.', 5, "isolated", True),
    ('{"mRS": 5} is the answer', 5, "isolated", True),
    ('a {"x": [1]} b', -1, "isolated", True),
    # lenient JSON
    ("{'mRS': 3}", 3, "lenient", True),
    ("{mRS: 3}", 3, "lenient", True),
    ('{"mRS": 3,}', 3, "lenient", True),
    ('{"mRS": "3", "x": [1, 2,], }', 3, "lenient", True),
    ('{"mRS": +3}', 3, "lenient", True),
    ('{"mRS": 0x3}', 3, "lenient", True),
    ('{"mRS": 3.}', 3, "lenient", True),
    ('{"mRS": .3e1}', 3, "lenient", True),
    ('{"mRS": 3 // sure\n}', 3, "lenient", True),
    ('{"mRS": /* sure */ 3}', 3, "lenient", True),
    ("{mRS: 9}", -1, "default", False),
    # repaired JSON
    ('{"mRS": 3', 3, "repaired", True),
    ('{"mRS": 3, "x": [1, {"y": 2', 3, "repaired", True),
    # a block that never closes is the whole answer, its leading words included
    ('text {"mRS": 3', 3, "field_regex", True),
    # field pattern
    ('{"mRS": 03}', 3, "field_regex", True),
    ('{"mRS": 3, "x": "cut', 3, "field_regex", True),
    ('[{"mRS": 3}]', 3, "field_regex", True),
    ('{"a": 1} {"mRS": 3}', 3, "field_regex", True),
    ('{"a": 1}, {"mRS": 3}', 3, "field_regex", True),
    ('{"a": 1}],[{"mRS": 3}', 3, "field_regex", True),
    ('see {"mRS": 5} or {x}', 5, "field_regex", True),
    ('"mRS": 4', 4, "field_regex", True),
    ('<think>{note}</think>\n{"mRS": 3}', 3, "field_regex", True),
    ('{"mRS": null} then {"mRS": 3}', -1, "default", False),
    # nothing to find
    ("} {", -1, "default", False),
    # the last closer stands before the first opener: the block is empty
    ('} "mRS": 3 {', -1, "default", False),
    ("no score", -1, "default", False),
    ("[1, 2]", -1, "default", False),
    ("3", -1, "default", False),
    ("", -1, "empty", False),
    (" \n ", -1, "empty", False),
    (None, -1, "empty", False),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SCORES)], "i int, output_text string")
    rows = extract_structured(df).orderBy("i").collect()
    got = [(r.output_text, r.record.mRS, r.status, r.valid) for r in rows]
    assert got == SCORES


FIELDS = (
    Field("name", "string"),
    Field("tags", "list[string]"),
    Field("sizes", "list[float]", default=[]),
    Field("counts", "list[int]", default=[]),
    Field("price", "float", default=0.5),
    Field("stock", "bool", default=False),
)


OTHER_KINDS = [
    (
        '{"name": "a", "tags": ["x"], "sizes": [1, "2", true], "counts": [1.0, "2"], "price": "2.5", "stock": "yes"}',
        ("a", ["x"], [1.0, 2.0, 1.0], [1, 2], 2.5, True),
        "direct",
        True,
    ),
    ('{"name": "a", "tags": []}', ("a", [], [], [], 0.5, False), "direct", True),
    ('{"name": 3, "tags": ["x"]}', (None, ["x"], [], [], 0.5, False), "field_regex", False),
    ('{"tags": ["x"]}', (None, ["x"], [], [], 0.5, False), "field_regex", False),
    ('{"name": "a", "tags": [1]}', ("a", ["1"], [], [], 0.5, False), "field_regex", True),
    (
        '{"name": "say \\"hi\\"", "tags": ["a, b", "c"], "sizes": [1, 2.5], "counts": [1, 2], "price": 4, "stock": true oops}',
        ('say "hi"', ["a", "b", "c"], [1.0, 2.5], [1, 2], 4.0, True),
        "field_regex",
        True,
    ),
    ('{"name": "a", "counts": [1, 2.5], "tags": ["x"]', ("a", ["x"], [], [], 0.5, False), "field_regex", True),
    ('{x "sizes": ["1", "2.5"], "counts": ["3"]}', (None, [], [1.0, 2.5], [3], 0.5, False), "field_regex", False),
    ('{"name": "torn\\", "tags": ["x\\", "y"] z}', ('torn", ', ["x\\", "y"], [], [], 0.5, False), "field_regex", True),
    ("nothing", (None, [], [], [], 0.5, False), "default", False),
]


def test_other_kinds(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(OTHER_KINDS)], "i int, output_text string")
    rows = extract_structured(df, schema=FIELDS).orderBy("i").collect()
    assert [(r.output_text, tuple(r.record), r.status, r.valid) for r in rows] == OTHER_KINDS


def test_repair(spark):
    cases = [
        ('{"a": [1, 2', '{"a": [1, 2]}'),
        (' {"a": "}" ', '{"a": "}"'),
        ("[{[", "[{[]}]"),
        ("{]", "{]}"),
        ("plain ", "plain"),
        ('{"a": [1]}', '{"a": [1]}'),
    ]
    df = spark.createDataFrame(cases, "s string, e string")
    once = df.withColumn("r", repair_truncated(F.col("s")))
    assert [(r.r, r.e) for r in once.collect()] == [(e, e) for _, e in cases]
    twice = once.withColumn("rr", repair_truncated(F.col("r")))
    assert twice.where("r <> rr").count() == 0


def test_isolate_block(spark):
    cases = [
        ("a {b} c} d", "{b} c}"),
        ("x [1] {y}", "[1]"),
        ("x {1 [2] ", "x {1 [2] "),
        ("``` [1, 2] ``` and ```json {3} ```", "[1, 2]"),
        ("```{1} a {2}```", "{1} a {2}"),
        ("none", "none"),
        ("} a {", ""),
    ]
    df = spark.createDataFrame(cases, "s string, e string")
    assert [r[0] for r in df.select(isolate_block(F.col("s"))).collect()] == [e for _, e in cases]


def test_wide_names(spark):
    df = spark.createDataFrame([(1, 0, '{"mRS": 2}'), (1, 1, "x"), (2, 0, '{"mRS": 5}')], "row_id int, run_idx int, output_text string")
    wide = predictions_wide(extract_structured(df), ["row_id"], ["mRS"], 2).orderBy("row_id")
    assert wide.columns == ["row_id", "mRS_000", "mRS_001"]
    assert [tuple(r) for r in wide.collect()] == [(1, 2, -1), (2, 5, None)]


def test_registry():
    with pytest.raises(ValueError, match="no schema is registered"):
        get_schema("Nope")
    assert '"maximum": 6' in json_schema("PatientInfoSchema")
    assert '"required": ["event_date", "event_type"]' in json_schema("ClinicalEventDate")


def test_record_rules(spark):
    fields = get_schema("ClinicalEventDate")
    rows = [("2024-02-31", "Admission"), ("2024-13-01", "Discharge"), ("2024-01-01x", "Exit"), (None, "Procedure")]
    df = spark.createDataFrame(rows, "event_date string, event_type string")
    found = df.select(violations(fields, F.struct("event_date", "event_type"))).collect()
    assert [r[0] for r in found] == [
        [],
        ["event_date:pattern"],
        ["event_date:pattern", "event_type:not_allowed"],
        ["event_date:missing"],
    ]


def test_no_python_and_no_shuffle_in_extraction(spark):
    df = spark.createDataFrame([("x",)], "output_text string")
    plan = extract_structured(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_long_answers_do_not_exhaust_the_stack(spark):
    n = 100_000
    strings = ", ".join('"s\\"%d"' % i for i in range(n))
    numbers = ", ".join(str(i) for i in range(n))
    quoted = "q\\" * n
    text = '{"name": "%s", "tags": [%s], "sizes": [%s], "mRS": 4, "x": {' % (quoted.replace("q\\", 'q\\"'), strings, numbers)
    broken = text + "[" * 1000 + " oops"
    df = spark.createDataFrame([(broken,)], "output_text string")
    row = extract_structured(df, schema=FIELDS[:3]).first()
    assert row.status == "field_regex" and row.record.name == 'q"' * n
    assert len(row.record.tags) == n and len(row.record.sizes) == n
    spaces = spark.createDataFrame([("```json" + " " * n + '{"mRS": 4' + "}" * n + " " * n,)], "output_text string")
    assert extract_structured(spaces).first().record.mRS == 4


HOSTILE = [
    ('{"other": {"mRS": true}, "mRS": "true"}', -1, "default"),
    ("{mRS: 0x" + "0" * 48 + "3}", 3, "lenient"),
    ("{mRS: 0xFFFFFFFFFFFFFFFFFFFFFFFF}", -1, "default"),
    ('{"mRS": 1e400}', 1, "field_regex"),
    ('{"mRS":\u00a03}', 3, "field_regex"),
    ('{"mRS": {"a": 1, "a": 2}}', -1, "default"),
    ('{"x": {"a": 1, "a": 2}, "mRS": 3}', 3, "direct"),
    ("{'note': 'see: +3, } at: 0x1F', 'mRS': 2,}", 2, "lenient"),
    ('{mRS: +3, note: "a, ]"}', 3, "lenient"),
]


def test_hostile_answers(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(HOSTILE)], "i int, output_text string")
    rows = extract_structured(df).orderBy("i").collect()
    assert [(r.output_text, r.record.mRS, r.status) for r in rows] == HOSTILE


def test_strings_keep_their_text_and_types(spark):
    answers = [
        "{'name': 'see: +3, }', 'tags': ['0x1F', ', ]']}",
        '{"first-name": "x", "name": 3, "tags": ["y"]}',
        "{'name': 'at: 0x1F .5', 'tags': [],}",
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, output_text string")
    rows = extract_structured(df, schema=FIELDS[:2]).orderBy("i").collect()
    assert [(r.record.name, r.record.tags, r.status) for r in rows] == [
        ("see: +3, }", ["0x1F", ", ]"], "lenient"),
        (None, ["y"], "field_regex"),
        ("at: 0x1F .5", [], "lenient"),
    ]


JSON5 = [
    ("{a: 'b'}", {"a": "b"}),
    ("{'a': \"it's\", b: 'say \"x\"'}", {"a": "it's", "b": 'say "x"'}),
    (r"{a: '\x41\u00e9\'\"\\\/\b\f\n\r\t\v\0\q'}", {"a": "Aé'\"\\/\b\f\n\r\t\v\0q"}),
    ("{a: 'x\\\ny\\\r\nz\\\u2028.'}", {"a": "xyz."}),
    ("{a: 'tab\there \u2029 //no /*comment*/'}", {"a": "tab\there \u2029 //no /*comment*/"}),
    ("// c\n{/**/a/* : */: // }\n1,/*,*/}", {"a": 1}),
    ("{ünï: 1, $: 2, _x1: 3, \\u0061b: 4, a\u200db: 5, null: 6, Infinity: 7}", {"ünï": 1, "$": 2, "_x1": 3, "ab": 4, "a\u200db": 5, "null": 6, "Infinity": 7}),
    ("[+1, -2, .5, 5., -.25e1, +1E2, 5.e1, 0x1f, -0XA, 0x00000000000000000000F]", [1, -2, 0.5, 5, -2.5, 100.0, 50.0, 31, -10, 15]),
    ("[Infinity, -Infinity, NaN, +Infinity]", [MARK + "Infinity", MARK + "-Infinity", MARK + "NaN", MARK + "Infinity"]),
    ("[0xFFFFFFFFFFFFFFFFFF]", [MARK]),
    ("[true, false, null, [], {}, '',]", [True, False, None, [], {}, ""]),
    ("\ufeff{a:\f{b: [1,],},}", {"a": {"b": [1]}}),
]
NO_JSON5 = ["{a: 'open}", "{a: 1 2}", "{a b: 1}", "[1abc]", "{a: 'x\ny'}", "{a: '\\xZZ'}", "[,]", "{a: /* open }", "{1a: 2}", "[Infinit]", "[1,,]", "['\\u12']"]


def test_json5_becomes_json(spark):
    rows = [(i, t) for i, t in enumerate([t for t, _ in JSON5] + NO_JSON5)]
    found = spark.createDataFrame(rows, "i int, t string").repartition(3).select("i", to_json(F.col("t")).alias("j")).collect()
    found = {r.i: r.j for r in found}
    for i, (text, value) in enumerate(JSON5):
        assert json.loads(found[i]) == value, text
    for i, text in enumerate(NO_JSON5, len(JSON5)):
        with pytest.raises(ValueError):
            print(text, json.loads(found[i]))


def test_long_json5_does_not_recurse(spark):
    text = "{a: '" + "\\'x\"" * 50_000 + "', /*" + "*" * 50_000 + "*/ b: [" + "+1, " * 20_000 + "]}"
    (row,) = spark.createDataFrame([(text,)], "t string").select(to_json(F.col("t")).alias("j")).collect()
    assert json.loads(row.j) == {"a": "'x\"" * 50_000, "b": [1] * 20_000}


def test_marks_are_no_text(spark):
    fields = (Field("a", "string", default="none"), Field("x", "float", default=0.0), Field("s", "list[string]", default=()))
    rows = [("{a: Infinity, x: 1}",), ("{a: 'k', x: -Infinity}",), ("{a: 'k', s: ['b', NaN]}",), ("{a: 'k', x: NaN}",)]
    out = extract_structured(spark.createDataFrame(rows, "t string").coalesce(1), "t", fields).collect()
    assert [r.status for r in out] == ["default", "lenient", "default", "lenient"]
    assert out[1].record.x == float("-inf") and out[3].record.x != out[3].record.x
