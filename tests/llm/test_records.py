import json
import random
from collections import defaultdict

from wharfside.llm import records
from wharfside.tables import EXPORT_FIELDS


def test_normal_form():
    assert records.normal_text("  Straße, É1_-​ ") == "strasseé1"
    assert records.normal_text("é") == "é"
    assert records.normal_form({"B": None, "a": ["x", 1.5], "c": {"d": ""}}) == "{a:x15}"
    assert records.merkle({"a": "1", "b": "2"}) == records.merkle({"b": "2", "a": "1", "c": ""}) != records.merkle({"a": "2", "b": "1"})


def _variant(rng, record):
    items = list(record.items())
    rng.shuffle(items)
    out = {}
    for k, v in items:
        k = rng.choice([k, k.upper(), k.replace("_", "-"), "".join(w.title() for w in k.split("_"))])
        if not v:
            if rng.random() < 0.5:
                out[k] = rng.choice([None, ""])
            continue
        out[k] = rng.choice([v, v.upper(), v + "!", " " + v.replace(" ", " "), v.replace(":", " : ")])
    return json.dumps(out, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))


def test_record_copies(spark):
    rng = random.Random(2)
    base = [{f: rng.choice(["", f"{f} {i}é:x"]) for f in EXPORT_FIELDS} for i in range(12)]
    lines, truth = [], defaultdict(list)
    for i in range(400):
        k = 0 if rng.random() < 0.4 else rng.randrange(12)
        lines.append((i, "clash", _variant(rng, base[k])))
        truth[tuple(base[k].values())].append(i)
    lines += [(1000, "x", "{broken"), (1001, "x", None), (1002, "x", "[1]"), (1003, "x", ""), (None, "x", "{}")]
    rng.shuffle(lines)
    frame = spark.createDataFrame(lines, "line_id bigint, digest string, line string")
    entries = spark.createDataFrame(
        [(1, 5, "a", None, None, "", "D", "1"), (2, 5, "A!", "", "", None, "d", "1."), (3, 6, "a", None, None, "", "D", "1"), (4, None, "a", None, None, None, None, None), (5, None, "A", None, None, None, None, None), (5, None, "A", None, None, None, None, None)],
        "id bigint, catalog_id bigint, urn string, display_name string, media_type string, ref_url string, description string, version string",
    )
    got = {tuple(r) for r in records.record_copies(records.index_records(frame, entries)).collect()}
    want = {("export_lines", min(ids), i) for ids in truth.values() for i in ids if i != min(ids)} | {("catalog_entries", 1, 2), ("catalog_entries", 4, 5)}
    assert got == want
    counts = {(r.table_name, r.first_id): r.copies for r in records.distinct_records(records.index_records(frame, entries)).collect()}
    assert counts["catalog_entries", 4] == 3 and sum(n for (t, _), n in counts.items() if t == "export_lines") == 400
    assert records.record_copies(records.index_records(frame.limit(0), entries.limit(0))).count() == 0


def test_equal_digests_of_different_records_stay_apart(spark):
    rows = spark.createDataFrame([("t", 1, bytearray(b"d"), "x"), ("t", 2, bytearray(b"d"), "y"), ("t", 3, bytearray(b"d"), "x"), ("t", 4, bytearray(b"e"), "x")], records.SCHEMA)
    assert {tuple(r) for r in records.record_copies(rows).collect()} == {("t", 1, 3)}


def test_long_values(spark):
    long = "word " * 200_000
    frame = spark.createDataFrame([(1, json.dumps({"urn": long})), (2, json.dumps({"URN": long.upper()})), (3, json.dumps({"urn": long + "x"}))], "line_id bigint, line string")
    assert {tuple(r) for r in records.record_copies(records.line_records(frame)).collect()} == {("export_lines", 1, 2)}
