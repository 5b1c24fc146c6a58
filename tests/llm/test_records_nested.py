import json

from wharfside.llm import records


def test_nested_nodes_have_digests():
    a = {"x": {"b": ["1", {"c": "d", "e": None}], "a": "T"}}
    b = {"X": {"A": "t!", "B": ["1", {"C": "D"}]}}
    assert records.node(a) == records.node(b) and len(records.node(a)[1]) == 16
    inner = records.node({"c": "d"})[1]
    assert records.node([{"c": "d"}, "z"])[1] == records._digest(b"[", inner, records.node("z")[1])  # ordered
    assert records.node(["z", {"c": "d"}])[1] != records.node([{"c": "d"}, "z"])[1]
    children = sorted(records._digest(k.encode(), b"\x1f", records.node(v)[1]) for k, v in (("p", "1"), ("q", {"c": "d"})))
    assert records.node({"q": {"c": "d"}, "p": 1})[1] == records._digest(b"{", *children)  # sorted digests
    assert records.node({"a": [{}, None]}) == ("", b"") and records.normal_form(["a", "b"]) == "ab"
    assert records.merkle({"f": "{c:d}"}, {"f": inner}) != records.merkle({"f": "{c:d}"})


def test_copies_of_nested_records(spark):
    lines = [{"tags": [{"k": "v", "w": [1, 2]}]}, {"TAGS": [{"W": [1, 2], "K": "V"}]}, {"tags": [{"k": "v", "w": [2, 1]}]}]
    frame = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "line_id bigint, line string")
    assert {tuple(r) for r in records.record_copies(records.line_records(frame)).collect()} == {("export_lines", 0, 1)}


def test_records_of_any_depth(spark):
    def line(deep, leaf, shout=False):
        text = '{"tags":' + '{"k":' * deep + "[" * deep + json.dumps(leaf) + ',{"z":1}' + "]" * deep + "}" * deep + "}"
        return text.upper() if shout else text

    rows = []
    for i, deep in enumerate((500, 5_000, 50_000)):
        rows += [(i * 10, line(deep, "v")), (i * 10 + 1, line(deep, "v!", True)), (i * 10 + 2, line(deep, "w"))]
    frame = spark.createDataFrame(rows, "line_id bigint, line string")
    assert {tuple(r) for r in records.record_copies(records.line_records(frame)).collect()} == {("export_lines", i * 10, i * 10 + 1) for i in range(3)}
    assert sum(r.copies for r in records.distinct_records(records.line_records(frame)).collect()) == 9
