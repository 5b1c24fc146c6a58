"""Nested documents, times, packed fields and snapshot changes on small fixtures."""

import json
import random
from collections import defaultdict
from datetime import UTC, datetime

import pyarrow as pa
import pytest

from wharfside.functions.instants import utc_micros
from wharfside.functions.jsontext import canonical, json_text, read_json
from wharfside.functions.packed import BAD_BRACKET, BAD_QUOTE, split_values
from wharfside.operators import changes, instants, nested, packed, snapshots
from wharfside.scratch import finished_tables
from wharfside.skew import join_unique, rank_in_group
from wharfside.tables import EXPORT_FIELDS


def _us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 10**6


@pytest.mark.parametrize(
    ("raw", "zone", "order", "want"),
    [
        ("2024-03-01T12:00:00Z", "", "", _us(2024, 3, 1, 12)),
        ("2024-03-01 12:00:00,1239999 +0530", "", "", _us(2024, 3, 1, 6, 30) + 123999),
        ("2024-03-01t12:00z", "", "", _us(2024, 3, 1, 12)),
        ("20240301T120000Z", "", "", _us(2024, 3, 1, 12)),
        ("2024-061T12:00:00Z", "", "", _us(2024, 3, 1, 12)),
        ("2024-W09-5T12:00:00Z", "", "", _us(2024, 3, 1, 12)),
        ("1709294400", "", "", _us(2024, 3, 1, 12)),
        ("1709294400123", "", "", _us(2024, 3, 1, 12) + 123000),
        ("1709294400.5", "", "", _us(2024, 3, 1, 12) + 500000),
        ("1709294400123456789", "", "", _us(2024, 3, 1, 12) + 123456),
        ("01/03/2024 12:00", "Etc/UTC", "dmy", _us(2024, 3, 1, 12)),
        ("03/01/24 12:00 PM", "Etc/UTC", "mdy", _us(2024, 3, 1, 12)),
        ("03/01/24 12:00 AM", "Etc/UTC", "mdy", _us(2024, 3, 1)),
        ("25/12/2024 00:00", "Etc/UTC", "mdy", _us(2024, 12, 25)),
        ("01/03/2024 12:00", "Etc/UTC", "", None),
        ("Fri, 01 Mar 2024 17:30:00 IST", "Asia/Kolkata", "dmy", _us(2024, 3, 1, 12)),
        ("March 1, 2024 at 12:00:05 PM UTC+01:00", "", "", _us(2024, 3, 1, 11, 0, 5)),
        ("2024-03-10T02:30:00", "America/New_York", "", None),
        ("2024-11-03T01:30:00", "America/New_York", "", None),
        ("2024-11-03T01:30:00 EST", "America/New_York", "", _us(2024, 11, 3, 6, 30)),
        ("2024-11-03T01:30:00-04:00[America/New_York]", "", "", _us(2024, 11, 3, 5, 30)),
        ("2024-07-01T12:00[Europe/Berlin]", "Asia/Tokyo", "", _us(2024, 7, 1, 10)),
        ("2024-02-30T10:00:00Z", "", "", None),
        ("2024-03-01T25:10:00Z", "", "", None),
        ("2024-03-01", "Etc/UTC", "", None),
        ("0000-00-00T00:00:00Z", "", "", None),
        ("2024-03-01 12:00:00 XYZ", "Etc/UTC", "", None),
        ("", "Etc/UTC", "dmy", None),
        (None, None, None, None),
        ("9" * 5000, "Etc/UTC", "dmy", None),
        ("2015-07-01 12:00", "Europe/Berlin", "", _us(2015, 7, 1, 10)),
        ("2035-01-01T00:00:00Z", "", "", _us(2035, 1, 1)),
        ("2012-07-01 12:00 MSK", "Europe/Moscow", "", _us(2012, 7, 1, 8)),
        ("1420113600", "", "", _us(2015, 1, 1, 12)),
    ],
)
def test_utc_micros(raw, zone, order, want):
    assert utc_micros(raw, zone, order) == want


def test_entry_instants_and_incremental_dictionary(spark, tmp_path):
    entries = spark.createDataFrame(
        [(1, 1, "2024-03-01 12:00", "x"), (2, 1, "2024-03-01 12:00", "x"), (3, 2, "01/02/2024 00:00", "y"), (4, 9, "2024-03-01T12:00:00Z", None), (5, 9, "2024-03-01 12:00", None), (6, None, None, ""), (7, 1, " ", "")],
        "id bigint, catalog_id bigint, entry_updated_at string, tz_name string",
    )
    catalogs = spark.createDataFrame([(1, "https://a.b.del.example:81/x", 5), (2, "http://q@h.nyc.example", None)], "id bigint, source_url string, raw bigint")
    locales = spark.createDataFrame([("del.example", "Asia/Kolkata", "dmy"), ("nyc.example", "America/New_York", "mdy")], "host_suffix string, tz_name string, date_order string")
    want = [(1, _us(2024, 3, 1, 6, 30)), (2, _us(2024, 3, 1, 6, 30)), (3, _us(2024, 1, 2, 5)), (4, _us(2024, 3, 1, 12))]
    path = f"file://{tmp_path}/known"
    for _ in range(2):
        got = instants.entry_instants(entries, catalogs, locales, path)
        assert sorted(map(tuple, got.collect())) == want
    assert spark.read.parquet(f"{path}/*").count() == 4
    assert len(finished_tables(spark, path)) == 1  # the second run had nothing to parse
    later = entries.unionByName(spark.createDataFrame([(8, 1, "2030-03-01 12:00", "x")], entries.schema))
    assert instants.entry_instants(later, catalogs, locales, path).count() == 5
    assert instants.entry_instants(later, catalogs, locales, path, years=(2022, 2027)).count() == 4
    new = sorted(spark.read.parquet(x).count() for x in finished_tables(spark, path))
    assert new == [1, 4]  # only the new triple was parsed
    spark.read.parquet(f"{path}/*").write.parquet(f"{path}/beside")  # another run that parsed the same
    assert instants.entry_instants(later, catalogs, locales, path).count() == 5
    assert instants.entry_instants(entries.limit(0), catalogs, locales).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('["a","b, c",null,"",1]', ["a", "b, c", "1"]),
        ("['it''s', \"b\"]", ["it's", "b"]),
        ('"[\\"a\\", \\"b\\"]"', ["a", "b"]),
        ('{a,"b, c",NULL}', ["a", "b, c"]),
        ("a, b;c|d\te，f、g • h", list("abcdefgh")),
        ('"x, y" , z\\, w', ["x, y", "z, w"]),
        ('say "hi" now, b', ['say "hi" now', "b"]),
        ("what's new, b", ["what's new", "b"]),
        ('"summarise the ""x"" report";b', ['summarise the "x" report', "b"]),
        ("- a\n- b-c\n* d\n2. e", ["a", "b-c", "d", "e"]),
        (", ,a,,", ["a"]),
        ("a, a", ["a", "a"]),
        ("on|off", ["on", "off"]),
        ("", []),
        ("[]", []),
        ("{}", []),
        (" \t", []),
        (None, []),
    ],
)
def test_split_values(text, want):
    assert [v for v, _ in split_values(text)] == want


def test_split_errors_and_long_texts():
    assert split_values('"open, b') == [('"open', BAD_QUOTE), ("b", 0)]
    assert split_values("[a, b") == [("a", BAD_BRACKET), ("b", BAD_BRACKET)]
    many = [f"v{i}" for i in range(200_000)]
    assert [v for v, _ in split_values(",".join(many))] == many


def test_quoted_however_often():
    text = json.dumps(["a", "b, c"])
    for _ in range(12):
        text = json.dumps(text)
        assert [v for v, _ in split_values(text)] == ["a", "b, c"]
    assert [v for v, _ in split_values('["a",' + "[" * 3_000 + '"b"' + "]" * 3_000 + "]")] == ["a", "b"]
    assert len(split_values(", ".join("“open" + str(i) for i in range(100_000)))) == 100_000  # each quote is looked for once


def test_split_round_trip():
    """Values written with quotes in any notation come back."""
    rng = random.Random(5)
    signs = ["a", "B", "é", ",", ";", "|", "、", "•", "\t", " x", "'s", "日"]
    for _ in range(400):
        values = ["v" + "".join(rng.choices(signs, k=rng.randint(0, 6))).strip() for _ in range(rng.randint(1, 5))]
        for text in (json.dumps(values), json.dumps(json.dumps(values)), "{" + ",".join(json.dumps(v, ensure_ascii=False) for v in values) + "}", rng.choice([", ", ";", " | ", "\n"]).join('"' + v + '"' for v in values)):
            assert [v for v, _ in split_values(text)] == [v.strip() for v in values], text


def test_split_fields(spark):
    rows = spark.createDataFrame([(1, "a,b", None, "z"), (1, "a,b", None, "z"), (2, None, "['q']", "z"), (None, "c", "", "z")], "row_id bigint, tags string, representative_queries string, item string")
    got = packed.split_fields(rows, ["tags", "representative_queries"]).collect()
    assert sorted((r.row_id or 0, r.field_name, r.item_pos, r.item) for r in got) == sorted(
        [(1, "tags", 1, "a"), (1, "tags", 2, "b")] * 2 + [(2, "representative_queries", 1, "q"), (0, "tags", 1, "c")]
    )
    assert packed.split_fields(rows.limit(0), ["tags"]).count() == 0


def _doc(entries, **more):
    return json.dumps({"entries": entries} | more)


def test_flatten(spark):
    att = {"type": "T", "uri": "u"}
    inner = {"entries": {"identifier": "in", "trustManifest": json.dumps({"attestations": att})}, "HOST": {"trustManifest": {"attestations": [att]}}}
    doc = _doc([None, {"identifier": "a", "Type": "Application/AI-Catalog+json; x=1", "data": json.dumps(inner)}, {"type": "text/html", "data": inner}, 7], host={"trustManifest": {"attestations": [None, att]}})
    rows = spark.createDataFrame([(1, doc, "n"), (2, "not json", "n"), (3, None, "n"), (4, "[]", "n"), (5, _doc([]), "n"), (6, _doc({"identifier": 5}), "n"), (7, '{"entries":[NaN]}', "n")], "id bigint, raw_json string, node_path string")
    got = {tuple(r) for r in nested.found(nested.flatten_catalogs(rows)).collect()}
    assert got == {
        (1, "entries[1]", ""), (1, "entries[2]", ""), (1, "host/trustManifest/attestations[1]", "host"), (1, "entries[1]/data/entries[0]", "entries[1]"),
        (1, "entries[1]/data/entries[0]/trustManifest/attestations[0]", "entries[1]/data/entries[0]"), (1, "entries[1]/data/host/trustManifest/attestations[0]", "entries[1]/data/host"), (6, "entries[0]", ""),
    }
    flat = nested.flatten_catalogs(rows)
    assert {(r.identifier, r.type) for r in nested.entries(flat).filter("catalog_id = 6").collect()} == {("5", None)}
    assert nested.flatten_catalogs(rows.limit(0)).count() == 0


def _brute(snapshots):
    """Changes between consecutive {key: value} snapshots."""
    out = set()
    for (_, a), (i, b) in zip(snapshots, snapshots[1:], strict=False):
        for k in a.keys() | b.keys():
            if k not in a:
                out.add((i, k, "added"))
            elif k not in b:
                out.add((i, k, "removed"))
            elif a[k] != b[k]:
                out.add((i, k, "changed"))
    return out


def test_export_changes(spark):
    rng = random.Random(3)
    rows, held = [], defaultdict(dict)
    n = 0
    for snap in range(1, 6):
        if snap == 3:
            continue  # an empty snapshot
        for k in range(40):
            if rng.random() < 0.7:
                for late in range(rng.choice([1, 1, 2, 3])):
                    n += 1
                    version = rng.choice(["1", "2", "", None])
                    at = datetime(2026, 1, snap, late)
                    rows.append((n, snap, at, {"host": f"h{k % 3}", "urn": f"u{k}", "version": version}))
                    held[snap][f"h{k % 3}", f"u{k}"] = version or ""
    schema = "row_id bigint, snapshot_no int, delivered_at timestamp, owner string, " + ", ".join(f"{f} string" for f in EXPORT_FIELDS)
    frame = spark.createDataFrame([(i, s, at, "clash", *[v.get(f) for f in EXPORT_FIELDS]) for i, s, at, v in rows], schema)
    got = snapshots.export_changes(frame).collect()
    assert {(r.snapshot_id, (r.owner, r.urn), r.change_kind) for r in got} == _brute([(s, held[s]) for s in range(1, 6)])
    assert {r.changed_fields for r in got if r.change_kind == "changed"} == {1 << [f for f in EXPORT_FIELDS if f not in ("host", "urn")].index("version")}
    assert snapshots.export_changes(frame.limit(0)).count() == 0


def test_catalog_changes_with_blocks(spark):
    rng = random.Random(4)
    rows, series = [], defaultdict(list)
    for i in range(1, 60):
        url = rng.choice(["u1", "u1", "u1", "u2", None])
        entries = {f"e{k}": {"identifier": f"e{k}", "v": rng.randint(0, 1), "w": [1, {"a": 1, "b": 2}]} for k in range(5) if rng.random() < 0.6}
        listed = list(entries.values())
        rng.shuffle(listed)
        text = json.dumps({"entries": listed}, indent=rng.choice([None, 2])) if rng.random() < 0.9 else rng.choice(["{", None, "[]"])
        at = datetime(2026, 1, rng.randint(1, 9))
        rows.append((i, url, at, text))
        if text and text.startswith("{") and len(text) > 1:
            series[url].append((at, i, {k: canonical(v) for k, v in entries.items()}))
    got = changes.catalog_changes(spark.createDataFrame(rows, "id bigint, source_url string, fetched_at timestamp, raw_json string"), block=3).collect()
    want = {(i, (url, k), kind) for url, s in series.items() for i, k, kind in _brute([(i, v) for _, i, v in sorted(s, key=lambda x: x[:2])])}
    assert {(r.snapshot_id, (r.owner, r.urn), r.change_kind) for r in got} == want and len(got) == len(want)


def test_skew_helpers(spark, monkeypatch):
    import wharfside.skew as skew

    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    monkeypatch.setattr(skew, "HOT_PARTS", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(100)] + [(f"k{i}", i) for i in range(20)] + [(None, 1)], "k string, i bigint")
    dim = rows.filter("k IS NOT NULL").groupBy("k").count().selectExpr("k", "length(k) AS v", "count AS n")
    assert join_unique(rows, dim, ["k"], "n").count() == 120
    ranked = rank_in_group(rows, ["k"], ["i"]).collect()
    by = defaultdict(list)
    for r in ranked:
        by[r.k].append((r.i, r["rank"], r.rank_size))
    assert len(ranked) == 121 and all(sorted(v) == [(i, n, len(v)) for n, (i, _, _) in enumerate(sorted(v), 1)] for v in by.values())


def test_read_json():
    assert read_json('{"a":1.0}') == {"a": 1.0} and canonical({"b": 1, "a": 1.0}) == '{"a":1,"b":1}'
    for deep in (500, 5_000, 50_000):
        for text in ("[" * deep + "1" + "]" * deep, '{"a":' * deep + "null" + "}" * deep):
            assert canonical(read_json(text)) == text == json_text(read_json(text))
    for bad in (None, "", "{", "NaN", '{"a":Infinity}', "[" * 100_000, "[" * 5_000 + "1" + "]" * 4_999, "[" * 5_000 + "]" * 5_001):
        assert not isinstance(read_json(bad), (dict, list))


def test_documents_of_any_depth(spark):
    rows = []
    for i, deep in enumerate((500, 5_000, 50_000)):
        rows.append((i, '{"entries":[{"identifier":"a","type":"t","metadata":' + '{"m":' * deep + "1" + "}" * deep + '},{"identifier":"b","url":' + "[" * deep + "]" * deep + "}]}"))
    nest = '{"entries":[{"identifier":"x","type":"application/ai-catalog","data":'
    rows.append((9, nest * 300 + '{"entries":[{"identifier":"last"}]}' + "}]}" * 300))
    rows += [(10, None), (11, "{"), (12, "[]"), (13, '{"entries":[' + "[" * 50_000 + "]}")]
    frame = spark.createDataFrame(rows, "id bigint, raw_json string")
    found = nested.flatten_catalogs(frame)
    assert {(r.catalog_id, r["count"]) for r in nested.found(found).groupBy("catalog_id").count().collect()} == {(0, 2), (1, 2), (2, 2), (9, 301)}
    assert {r.url for r in nested.entries(found).filter("identifier = 'b'").collect()} == {"[" * d + "]" * d for d in (500, 5_000, 50_000)}
    assert {tuple(r) for r in nested.unreadable(frame).collect()} == {(10, "null"), (11, "not JSON"), (12, "not an object"), (13, "not JSON")}
    twice = frame.filter("id < 3").unionByName(frame.filter("id < 3").selectExpr("id + 20 AS id", "replace(raw_json, '\"b\"', '\"c\"') AS raw_json")).selectExpr("id", "'u' || id % 20 AS source_url", "timestamp_seconds(id) AS fetched_at", "raw_json")
    assert {(r.urn, r.change_kind) for r in changes.catalog_changes(twice).collect()} == {("b", "removed"), ("c", "added")}


def test_columns_and_decoding_agree():
    """Documents of every variety give the same rows whether they are read into columns or one by one."""
    rng = random.Random(11)

    def attestations():
        one = {"type": "T", "uri": "u", "mediaType": rng.choice(["m", None])}
        return rng.choice([[one, one], [one], [], None, one, json.dumps([one]), [one, None], [one, 5]] if rng.random() < 0.4 else [[one, one], [one], []])

    def catalog(depth):
        entries = []
        for k in range(rng.randint(0, 3)):
            e = {"identifier": f"i{k}", "type": rng.choice(["application/ai-catalog+json", " Application/AI-Catalog ; v=1", "text/html", None]), "metadata": {"attestations": 3, "entries": "x"}}
            if rng.random() < 0.5:
                e["trustManifest"] = {"attestations": attestations()}
            if depth and rng.random() < 0.7:
                e["data"] = catalog(depth - 1)
            if rng.random() < 0.05:
                e["data"] = rng.choice([json.dumps(catalog(0)), 7, [1], "x"])
            if rng.random() < 0.05:
                e["description"] = rng.choice([1, None, {"a": 1}, "LONE"])
            entries.append(rng.choice([e, e, e, e, e, None, "text", json.dumps(e)]) if rng.random() < 0.3 else e)
        out = {"entries": entries if rng.random() < 0.95 else rng.choice([None, {"identifier": "one"}, "x"])}
        if rng.random() < 0.4:
            out["host"] = {"trustManifest": {"attestations": attestations()}}
        if rng.random() < 0.05:
            out["Entries"] = [{"identifier": "cased"}]
        return out

    texts = []
    for _ in range(400):
        text = json.dumps(catalog(rng.randint(0, 7)), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).replace("LONE", "\\ud800")
        if rng.random() < 0.05:
            text = rng.choice([text[:-1], text + text, text + "x", "[" + text + "]", "\ufeff" + text, text.replace("entries", "\\u0065ntries"), '{"entries":[{"identifier":"a"}],"entries":[]}', '{"entries":[{"identifier":"a","identifier":"b"}]}'])
        texts.append(text)
    ids, docs = pa.array(range(len(texts)), pa.int64()), pa.array([*texts[:-2], None, ""], pa.string())
    rows = lambda batches: sorted(repr(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for levels in (0, 2, 4):
        assert rows(nested._flatten(ids, docs, True, levels)) == rows(nested._flatten_decoded(ids, docs, True))


def test_snapshots_are_kept(spark, tmp_path):
    """A second run reads what is kept; a new snapshot is merged with the last only; a changed one is kept anew."""
    schema = "row_id bigint, snapshot_no int, delivered_at timestamp, " + ", ".join(f"{f} string" for f in EXPORT_FIELDS)

    def rows(snapshot, versions, late=0):
        blank = dict.fromkeys(EXPORT_FIELDS)
        return [(snapshot * 1000 + late + i, snapshot, datetime(2026, 1, snapshot, late % 24), *(blank | {"host": "h", "urn": f"u{i}", "version": v}).values()) for i, v in enumerate(versions)]

    path = f"file://{tmp_path}/store"
    one, two, three = rows(1, "aab"), rows(2, "aac"), rows(3, "bac")
    store = snapshots.open_store(spark, path)
    assert snapshots.keep(store, spark.createDataFrame(one + two, schema)) == [1, 2]
    store = snapshots.open_store(spark, path)
    assert snapshots.keep(store, spark.createDataFrame(one + two, schema)) == []
    assert snapshots.keep(store, spark.createDataFrame(three, schema)) == [3]
    newest = snapshots.compare(store, since=3)
    assert "Exchange" not in newest._jdf.queryExecution().executedPlan().toString()
    assert {x.split("seq=")[1][0] for x in newest.inputFiles()} == {"2", "3"}
    assert {(r.snapshot_id, r.urn, r.change_kind) for r in newest.collect()} == {(3, "u0", "changed")}
    spark.sql(f"DROP TABLE {store.name}")  # as in a new session
    store = snapshots.open_store(spark, path)
    assert {(r.snapshot_id, r.urn) for r in snapshots.compare(store).collect()} == {(2, "u2"), (3, "u0")}
    assert snapshots.keep(store, spark.createDataFrame(one + rows(1, "z", late=5) + two + three, schema)) == [1]
    assert {(r.snapshot_id, r.urn) for r in snapshots.compare(store).collect()} == {(2, "u0"), (2, "u2"), (3, "u0")}


def test_hot_keys_are_combined_first(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "HOT_LEAST", 10)
    schema = "row_id bigint, snapshot_no int, delivered_at timestamp, " + ", ".join(f"{f} string" for f in EXPORT_FIELDS)
    blank = dict.fromkeys(EXPORT_FIELDS)
    rows = [(i, 1 + i % 2, datetime(2026, 1, 1, 0, i % 60), *(blank | {"host": "h", "urn": "hot" if i < 300 else f"u{i // 2}", "version": str(i % 60)}).values()) for i in range(400)]
    got = snapshots.export_changes(spark.createDataFrame(rows, schema)).collect()
    assert {(r.urn, r.change_kind) for r in got} == {("hot", "changed")} | {(f"u{i}", "changed") for i in range(150, 200)} and len(got) == 51
