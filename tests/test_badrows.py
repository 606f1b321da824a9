import pytest

from stratavec.operators.badrows import _Bad, parse_line, rejected_offsets, rejects, strict_load

GOOD = [
    ("json", ' {"op":"Inserted","id":"a","string":"x","more":[1,{"b":1e999}]} '),
    ("json", '{"op":"Deleted","id":"a","string":5}'),
    ("json", '{"op":"Error","message":""}'),
    ("json", '{"op":"Deleted","id":"a","n":' + "9" * 6000 + "}"),
    ("json", '{"op":"Deleted","id":"a","z":' + "[" * 50000 + "]" * 50000 + "}"),
    ("json", '{"op":"Deleted","id":"\\ud800"}'),
    ("csv", "Inserted,a,b,"),
    ("csv", '"Inserted",a,"x ""y"", z\nnext",'),
    ("csv", "Error,,,broken"),
]
BAD = [
    ("json", "", "empty"), ("json", None, "null_body"), ("json", '{"op":"Deleted","id":"a"}{}', "text_after_object"), ("json", "[1]", "not_one_object"),
    ("json", "{'op':'Deleted'}", "broken_json"), ("json", '{"op":"Deleted","id":"a",}', "broken_json"), ("json", '{"op":"Deleted","id":NaN}', "broken_json"), ("json", '{"op":"Deleted","id":"a\nb"}', "broken_json"),
    ("json", '{"op":"Inserted","id":"a"}', "string_missing"), ("json", '{"op":"Inserted","id":1,"string":"x"}', "id_not_string"), ("json", '{"op":"inserted","id":"a","string":"x"}', "op_unknown"), ("json", '{"id":"a"}', "op_missing"),
    ("json", '{"op":"Deleted","z":' + "[" * 50000, "broken_json"), ("json", "﻿{}", "broken_json"),
    ("csv", "Inserted,a,b", "column_count"), ("csv", "Inserted,a,b,,", "column_count"), ("csv", 'Inserted,a,b"c,', "broken_quoting"), ("csv", 'Inserted,a,"b', "broken_quoting"), ("csv", 'Inserted,a,"b" ,', "broken_quoting"),
    ("csv", "Inserted,a,b,\n", "line_end"), ("csv", "Deleted,,,", "id_missing"), ("csv", 'Inserted,a,"",', "string_missing"), ("csv", "", "empty"), ("xml", "<a/>", "unknown_layout"), (None, "{}", "unknown_layout"),
]


def test_lines_one_by_one():
    for layout, body in GOOD:
        assert parse_line(layout, body)[0] in ("Inserted", "Deleted", "Error")
    for layout, body, why in BAD:
        with pytest.raises(_Bad, match=f"^{why}$"):
            parse_line(layout, body)


def test_load_and_rest_are_whole(spark):
    rows = [(k, a, b, "x") for k, (a, b) in enumerate(GOOD)] + [(100 + k, a, b, "x") for k, (a, b, _) in enumerate(BAD)]
    rows += rows[:3] + rows[-3:]  # repeated
    rows += [(None, "csv", "Deleted,a,,", "x"), (None, "csv", "Deleted,,,", "x"), (7, "csv", "Deleted,,,", "x")]  # no offset; an offset named twice
    df = spark.createDataFrame(rows, "line_id long, layout string, body string, op string")
    loaded = strict_load(df).collect()
    assert sorted(str(r.line_id) for r in loaded) == sorted([*map(str, range(len(GOOD))), "None"])
    bad = rejects(df).collect()
    assert {(r.line_id, r.reason) for r in bad} == {(100 + k, w) for k, (_, _, w) in enumerate(BAD)} | {(None, "id_missing"), (7, "id_missing")}
    assert len(bad) == len(BAD) + 2
    assert {r.line_id for r in rejected_offsets(df).collect()} == {100 + k for k in range(len(BAD))} | {None, 7}
    assert strict_load(df.limit(0)).count() == rejects(df.limit(0)).count() == 0
