"""Jobs, export files, look-ups, paging, schema checks, configuration."""

import json
import re
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from wharfside import config, schemas, tables
from wharfside.operators import export, frontier, store
from wharfside.plans import jobs
from wharfside.scratch import append_table, write_table
from wharfside.skew import numbered
from wharfside.sources import seeds
from wharfside.tables import EXPORT_FIELDS

NOW = datetime(2026, 3, 1)


def test_worker_flag_and_defaults():
    assert config.worker_part("1/4") == (1, 4)
    for bad in ("", "1", "4/4", "-1/4", "a/b", "0/0", "0/9000"):
        with pytest.raises(ValueError):
            config.worker_part(bad)
    assert config.or_default(0, 7) == 7 and config.or_default([], ["a"]) == ["a"] and config.or_default(3, 7) == 3
    assert config.counted(1, "catalog") == "1 catalog" and config.counted(2, "entry", "entries") == "2 entries"


def test_config_ranges_and_words():
    for given, where in (({"crawler": {"maxAttempts": 0}}, "config.crawler.maxAttempts"), ({"log": {"level": "loud"}}, "config.log.level"), ({"crawler": {"maxDepth": -1}}, "config.crawler.maxDepth")):
        with pytest.raises(ValueError, match=where):
            config.load_text(json.dumps(given))
    assert config.load_text('{"crawler":{"maxDepth":0}}')["crawler"]["maxDepth"] == 0


def test_databases():
    assert tables.database_options("postgres", "//h/db", "domains", bounds=(1, 9))["numPartitions"] == "32"
    assert "numPartitions" not in tables.database_options("sqlite3", "/x.db", "domains", bounds=(1, 9))
    with pytest.raises(ValueError, match="unsupported"):
        tables.database_options("oracle", "x", "domains")


def test_small_export_and_info(tmp_path):
    row = {"host": 'a"b', "urn": "<&>", "description": "x,\ny"}
    line = json.loads(export.small_export([row]))
    assert list(line) == EXPORT_FIELDS and line["urn"] == "<&>" and line["tags"] == "" and "\\u003c" in export.small_export([row])
    assert export.small_export([row], "csv").splitlines()[0] == ",".join(EXPORT_FIELDS) and '"a""b"' in export.small_export([row], "csv")
    (tmp_path / "f").write_text("12345")
    got = jobs.info(str(tmp_path / "none.json"), str(tmp_path))
    assert (got["config_exists"], got["storage_exists"], got["storage_bytes"]) == (False, True, 5)


def test_export_files(spark, tmp_path):
    rows = [(i, *([f"v{i}"] * 12), "　wide" if i == 3 else "q") for i in range(50, 0, -1)]
    joined = spark.createDataFrame(rows, "entry_id bigint, " + ", ".join(f"{c} string" for c in EXPORT_FIELDS)).repartition(5)
    for form, head in (("csv", 1), ("jsonl", 0)):
        told = export.write_export(joined, f"file://{tmp_path}/{form}", form)
        assert told == {"format": form, "out": f"file://{tmp_path}/{form}", "rows": 50}
        lines = [x for p in sorted((tmp_path / form).glob("part-*")) for x in p.read_text().splitlines()]
        assert len(lines) == 50 + head and [int(re.search(r"v(\d+)", x)[1]) for x in lines[head:]] == list(range(1, 51))
        if head:
            assert lines[0] == ",".join(EXPORT_FIELDS) and lines[3].endswith('"　wide"')
    broken = joined.limit(1).withColumn("host", F.expr("cast(X'61FF' AS string)"))
    assert '"host":"a\\ufffd"' in export.export_lines(broken, "jsonl").first().value
    with pytest.raises(ValueError):
        export.export_lines(joined, "xml")
    assert export.export_lines(joined.limit(0), "csv").count() == 1


def test_runs_and_look_ups(spark):
    runs, number = jobs.create_run(spark.createDataFrame([], jobs.RUNS), ["a.test"], NOW)
    done = jobs.finish_run(runs, number, NOW).first()
    assert (number, done.status, json.loads(done.seeds)) == (1, "done", ["a.test"])
    with pytest.raises(LookupError):
        jobs.finish_run(runs, 9, NOW)
    frame = spark.createDataFrame([(2, "h"), (1, "h")], "id bigint, host string")
    assert store.look_up(frame, host="h").id == 1
    with pytest.raises(store.NotFound):
        store.look_up(frame, host="x")


def test_verify_target(spark, tmp_path):
    good = {"specVersion": "1.0", "entries": [{"identifier": "urn:air:a.test:x", "displayName": "X", "type": "application/ai-skill", "url": "https://a.test/x", "representativeQueries": ["a", "b"]}]}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert jobs.verify_target(spark, str(tmp_path / "c.json"))["verdict"] == "valid"
    answers = spark.createDataFrame([("https://b.test/c", "https://b.test/c", 200, "application/json", bytearray(json.dumps(good).encode()), None)], schemas.RESPONSES)
    told = jobs.verify_target(spark, "https://b.test/c", answers)
    assert told["verdict"] == "valid_with_warnings" and [c["check_id"] for c in told["checks"] if not c["passed"]] == ["urn.publisher_matches"]
    with pytest.raises(LookupError):
        jobs.verify_target(spark, "https://c.test/", answers)


def test_reverify(spark):
    bad, fine = '{"entries":[]}', '{"specVersion":"1.0","entries":[]}'
    catalogs = spark.createDataFrame([(1, 1, fine, "invalid"), (2, 1, bad, "valid"), (3, 9, bad, "valid")], "id bigint, domain_id bigint, raw_json string, verification_status string")
    domains = spark.createDataFrame([(1, "a.test")], "id bigint, host string")
    entries = spark.createDataFrame([], "id bigint, catalog_id bigint, urn string")
    old = spark.createDataFrame([("catalog", 1, "old", "error", False, "m"), ("catalog", 3, "old", "error", False, "m")], schemas.TABLES["checks"])
    judged, checks, told = jobs.reverify(catalogs, entries, domains, old)
    assert {r.id: r.verification_status for r in judged.collect()} == {1: "valid", 2: "invalid", 3: "valid"}
    assert {r.subject_id for r in checks.filter("check_id = 'old'").collect()} == {3} and tuple(told.first()) == (3, 1)


def test_paging_and_factory(spark):
    items = spark.createDataFrame([(p, p * 10 + i, f"o{p}/r", f"https://h{p}-{i}.dev/") for p, n in enumerate((3, 3, 2, 3)) for i in range(n)], "page int, ord int, full_name string, homepage string")
    assert seeds.paged(items, 3, 10).count() == 8 and seeds.paged(items, 3, 2).count() == 6
    pages = spark.createDataFrame([("", "b", 1), ("b", "c", 2), ("c", "b", 3), ("z", "", 4)], "cursor string, next_cursor string, n int")
    assert sorted(r.n for r in seeds.listed_by_cursor(pages).collect()) == [1, 2, 3] and seeds.listed_by_cursor(pages, 2).count() == 2
    texts = spark.createDataFrame([(0, "https://a.example/ https://b.example/")], "ord bigint, text string")
    assert [r.host for r in seeds.build_seeder("curated", count=1)(texts).collect()] == ["a.example"]
    with pytest.raises(ValueError, match="unknown source"):
        seeds.build_seeder("none")
    logs = spark.createDataFrame([("Op", "d", "u", True, None, None, 0)], "operator string, description string, url string, usable boolean, start timestamp, end timestamp, ord int")
    with pytest.raises(seeds.NoLogs, match="Op"):
        seeds.need_ct_logs(logs, ["zzz"], F.lit(NOW))
    assert seeds.keywords([]) == seeds.CRTSH_KEYWORDS and seeds.keywords(["a"]) == ["a"]


def test_order_keys_do_not_collide(spark):
    """More values than the old fixed widths held keep their order."""
    servers = spark.createDataFrame([(0, None, [f"https://h{i}.example/" for i in range(3000)]), (1, None, ["https://late.example/"])], "ord int, name string, remotes array<string>")
    got = [r.host for r in seeds.server_hosts(servers, 3001).collect()]
    assert got[:2] == ["h0.example", "h1.example"] and got[2999:] == ["h2999.example", "late.example"]
    lists = spark.createDataFrame([("b", "x.b\ny.b"), ("a", "x.a\n\ny.a")], "path string, text string")
    assert [r.raw for r in seeds.listed_seeds(spark, lists, ["p"]).orderBy("ord").collect()] == ["p", "x.a", "y.a", "x.b", "y.b"]


def test_stored_schemas(spark):
    old = spark.createDataFrame([(1, "a.test")], "id bigint, host string")
    assert "domains.ard_status: absent, not string" in schemas.schema_problems(old, "domains")
    state = schemas.reconcile(spark, {"domains": old, "frontier": schemas.empty_state(spark)["frontier"].drop("worker_id")})
    assert state["domains"].count() == 1 and not schemas.schema_problems(state["domains"], "domains") and state["frontier"].count() == 0 and "probes" in state


def test_numbering_and_appending(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = numbered(rows, ["k"], "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 1) for i in range(1000)]
    assert numbered(rows.limit(0), ["k"]).count() == 0
    one = write_table(rows.filter("k < 3"), "t")
    two = append_table(one, rows.filter("k = 5"), "t")
    assert sorted(r.k for r in two.collect()) == [0, 1, 2, 5] and one.count() == 3
    assert set(one.inputFiles()) < set(two.inputFiles())  # nothing was written twice
    assert sorted(r.k for r in append_table(two.filter("k > 0"), rows.filter("k = 9"), "t").collect()) == [1, 2, 5, 9]


def test_turns_of_a_host(spark):
    items = spark.createDataFrame([(1, "https://a/1", "x"), (2, "https://a/2", "x"), (3, "https://b/1", "x")], "id bigint, url string, host string")
    got = {r.id: (r.not_before - NOW).total_seconds() for r in frontier.due_times(items, F.lit(NOW), per_second=0.5).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 0.0}
