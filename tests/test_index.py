"""Frontier, store, report and source operators on small tables."""

import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wharfside.functions.hosts import dedup_key
from wharfside.operators import frontier as fr
from wharfside.operators import reports, store
from wharfside.schemas import empty_state
from wharfside.sources import registry, seeds
from wharfside.streaming.responses import append_events, at_least

NOW = datetime(2026, 3, 1)
_FOUND = "kind string, url string, host string, depth int, priority int, run_id bigint, seq bigint"


def _frontier(spark, rows):
    """(id, url, host, status, attempts, priority, leased_until, worker)"""
    frame = spark.createDataFrame(rows, "id bigint, url string, host string, status string, attempts int, priority int, leased_until timestamp, worker_id string")
    full = frame.withColumns({"kind": F.lit("page_fetch"), "run_id": F.lit(1).cast("long"), "depth": F.lit(0), "last_error": F.lit("e"), "parent_catalog_id": F.lit(None).cast("long"), "registry_row_id": F.lit(None).cast("long"), "artifact_entry_id": F.lit(None).cast("long"), "updated_at": F.lit(NOW)})
    return fr.items(full).select(*empty_state(spark)["frontier"].columns)


def _state(frame, *columns):
    return sorted(tuple(r) for r in frame.select("id", *columns).collect())


def test_enqueue_budget_and_reactivation(spark):
    old = _frontier(spark, [(1, "u1", "h", "done", 2, 0, None, "w"), (2, "u2", "h", "pending", 1, 0, None, ""), (3, "u3", "g", "failed", 3, 0, None, ""), (4, "u4", "h", "in_flight", 1, 0, NOW, "w")])
    new = [("page_fetch", u, h, 5, 0, 9, i) for i, (u, h) in enumerate([("u1", "h"), ("u2", "h"), ("u4", "h"), ("n1", "h"), ("n1", "h"), ("n2", "h"), ("n3", "g"), ("n4", "g")])]
    got = fr.enqueue(old, fr.items(spark.createDataFrame(new, _FOUND)), F.lit(NOW), budget=4)
    rows = {r.url: r for r in got.collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4", "n1", "n3", "n4"}  # n2 is over the budget of its host
    assert (rows["u1"].status, rows["u1"].attempts, rows["u1"].depth, rows["u1"].run_id) == ("pending", 0, 5, 9)
    assert (rows["u2"].attempts, rows["u2"].depth) == (1, 0) and rows["u4"].status == "in_flight" and rows["u3"].status == "failed"
    assert [rows[u].id for u in ("n1", "n3", "n4")] == [5, 6, 7]
    assert fr.enqueue(old, fr.items(spark.createDataFrame(new, _FOUND)), F.lit(NOW), budget=0).count() == 4
    assert fr.enqueue(empty_state(spark)["frontier"], fr.items(spark.createDataFrame([], _FOUND)), F.lit(NOW)).count() == 0


def test_lease_cycle(spark):
    start = _frontier(spark, [(1, "a", "h", "pending", 0, 0, None, ""), (2, "b", "h", "pending", 0, 5, None, ""), (3, "c", "h", "pending", 2, 0, None, ""), (4, "d", "h", "in_flight", 0, 0, NOW - timedelta(1), "x")])
    leased, after = fr.dequeue(start, 2, F.lit(NOW), worker="w")
    assert [r.id for r in leased.collect()] == [2, 1]
    assert _state(after, "status", "worker_id") == [(1, "in_flight", "w"), (2, "in_flight", "w"), (3, "pending", ""), (4, "in_flight", "x")]
    ids = spark.createDataFrame([(1,), (3,), (4,), (None,)], "id bigint")
    assert _state(fr.complete(after, ids, F.lit(NOW), worker="w"), "status")[0::3] == [(1, "done"), (4, "in_flight")]
    errors = spark.createDataFrame([(1, "timeout", False), (2, "gone", True), (3, "x", True)], "id bigint, error string, permanent boolean")
    assert _state(fr.fail(after, errors, F.lit(NOW)), "status", "attempts")[:3] == [(1, "pending", 1), (2, "failed", 1), (3, "pending", 2)]
    assert _state(fr.requeue(after, ids, F.lit(NOW)), "status")[0] == (1, "pending")
    assert _state(fr.reclaim(after, F.lit(NOW)), "status")[3] == (4, "pending")
    assert tuple(fr.counts(after).first()) == (1, 3)


def test_domains(spark):
    present = spark.createDataFrame([(7, "old", NOW, None, "seed", "found_valid", NOW, NOW)], empty_state(spark)["domains"].schema)
    found = spark.createDataFrame([("old", "anchor", 1), ("new", "tranco", 3), ("new", "anchor", 2), (None, "seed", 0)], "host string, discovery_source string, seq bigint")
    got = store.upsert_domains(present, found, F.lit(NOW))
    assert sorted((r.id, r.host, r.discovery_source, r.ard_status) for r in got.collect()) == [(7, "old", "seed", "found_valid"), (8, "new", "anchor", "unprobed")]
    probed = store.record_probes(got, spark.createDataFrame([(8, NOW), (8, NOW - timedelta(1))], "domain_id bigint, probed_at timestamp"))
    later = F.lit(NOW + timedelta(hours=168))
    assert {r.host: r.f for r in probed.select("host", store.is_fresh(F.col("last_probed_at"), later).alias("f")).collect()} == {"old": False, "new": False}
    changed = store.update_status(probed, spark.createDataFrame([("new", "not_found", 1), ("new", "found_invalid", 2)], "host string, ard_status string, seq bigint"))
    assert {r.host: r.ard_status for r in changed.collect()} == {"old": "found_valid", "new": "found_invalid"}


def test_replace_checks(spark):
    checks = spark.createDataFrame([("catalog", 1, "a", "error", True, ""), ("entry", 10, "b", "error", True, ""), ("entry", 20, "b", "error", True, ""), ("catalog", 2, "a", "error", True, "")], empty_state(spark)["checks"].schema)
    entries = spark.createDataFrame([(10, 1), (20, 2)], "id bigint, catalog_id bigint")
    fresh = spark.createDataFrame([("catalog", 1, "new", "error", False, "m")], checks.schema)
    got = store.replace_checks(checks, entries, spark.createDataFrame([(1,)], "id bigint"), fresh)
    assert sorted((r.subject_type, r.subject_id, r.check_id) for r in got.collect()) == [("catalog", 1, "new"), ("catalog", 2, "a"), ("entry", 20, "b")]


def test_group_count_keeps_null_and_empty_apart(spark):
    from wharfside.operators.export import group_count

    rows = spark.createDataFrame([("",), (None,), (None,), ("x",)], "k string")
    assert sorted(tuple(r) for r in group_count(rows, "k").collect()) == [("(empty)", 1), ("(empty)", 2), ("x", 1)]
    assert reports.duplicate_groups(rows, ["k"]).count() == 1


def test_registry_walk(spark):
    pages = spark.createDataFrame(
        [("r", "", 200, 1, "t1"), ("r", "t1", 200, 2, "t2"), ("r", "t2", 200, 3, "t1"), ("e", "", 501, 0, ""), ("f", "", 200, 5, "x"), ("f", "x", 500, 6, "y"), ("f", "y", 200, 7, "")],
        "base_url string, page_token string, status int, results int, next_token string",
    )
    bases = spark.createDataFrame([("r",), ("e",), ("f",), ("none",)], "base_url string")
    got = registry.harvest(bases, pages)
    assert sorted((r.base_url, r.page_no, r.results) for r in got.collect()) == [("e", 1, 0), ("f", 1, 5), ("f", 2, 6), ("r", 1, 1), ("r", 2, 2), ("r", 3, 3)]
    assert registry.harvest(bases, pages, page_limit=1).count() == 3


def _hosts(frame):
    return [r.host for r in frame.orderBy("ord").collect()]


def test_sources(spark):
    lines = ["#host", "1\t2\t3\t4\tcom.one\t9", "short\tline", "", "2\t2\t3\t4\tcom.two\t9", "3\t2\t3\t4\tcom.two\t9", "4\t2\t3\t4\tcom.three\t9"]
    ranks = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord bigint, line string")
    assert _hosts(seeds.ranked_hosts(ranks, 5, offset=1)) == ["two.com", "three.com"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("top.csv", "1,*.a.com\n2,b.com\n3,c.com\n")
    assert _hosts(seeds.ranked_zip(spark.createDataFrame([(bytearray(packed.getvalue()),)], "content binary"), 2)) == ["a.com", "b.com"]
    certs = spark.createDataFrame([(0, 0, "x.com", "*.x.com\ny.com"), (0, 1, None, "localhost"), (1, 0, "z.com", None)], "query int, idx int, common_name string, name_value string")
    assert _hosts(seeds.crtsh_names(certs)) == ["x.com", "y.com", "z.com"]
    repos = spark.createDataFrame([(0, "o/r", "https://h.dev/x"), (1, "me/me.github.io", ""), (2, "a/b", None)], "ord int, full_name string, homepage string")
    assert _hosts(seeds.repository_hosts(repos)) == ["h.dev", "me.github.io"]
    servers = spark.createDataFrame([(0, "com.acme/x", ["https://m.acme.com/mcp"]), (1, "noslash", None)], "ord int, name string, remotes array<string>")
    assert _hosts(seeds.server_hosts(servers)) == ["m.acme.com", "acme.com"]
    listed = seeds.listed_seeds(spark, spark.createDataFrame([("p", " a.com \n# no\n\nb.com")], "path string, text string"), ["first"])
    assert [r.raw for r in listed.orderBy("ord").collect()] == ["first", "a.com", "b.com"]
    leaves = spark.createDataFrame([("L1", i, [f"n{i}.com"], i != 2) for i in range(4)] + [("L2", 0, ["z.com"], True)], "log string, index bigint, names array<string>, parsed boolean")
    assert _hosts(seeds.ct_names(leaves, ["L1", "L2"], 3)) == ["n1.com", "n3.com", "z.com"]
    assert [r.u for r in spark.range(1).select(F.explode(F.array(seeds.search_url(F.lit("https://r/")), seeds.search_url(F.lit("https://r/search")))).alias("u")).collect()] == ["https://r/search"] * 2


def test_log_choice(spark):
    day = timedelta(1)
    logs = [
        ("Good", "g 2026", "g1", True, NOW - day, NOW + day, 0), ("Good", "g far", "g2", True, NOW + 90 * day, NOW + 99 * day, 1), ("Good", "g near", "g3", True, NOW + 9 * day, NOW + 90 * day, 2),
        ("Good", "old", "g4", True, NOW - 9 * day, NOW, 3), ("Good", "retired", "g5", False, None, None, 4), ("Other", "x", "o1", True, None, None, 5), ("Late", "x", "l1", True, NOW + 500 * day, NOW + 600 * day, 6),
    ]
    frame = spark.createDataFrame(logs, "operator string, description string, url string, usable boolean, start timestamp, end timestamp, ord int")
    pick = lambda names: [r.url for r in seeds.choose_ct_logs(frame, names, F.lit(NOW)).collect()]
    assert pick([]) == ["g1", "g3", "o1"] and pick(["gOO"]) == ["g1", "g3"] and pick(["nobody"]) == []


def test_events(spark, tmp_path):
    events = spark.createDataFrame([("debug", "a"), ("info", "b"), ("error", "c"), (None, "d")], "level string, event string")
    assert {r.event for r in events.filter(at_least(F.col("level"), "info")).collect()} == {"b", "c", "d"}
    for _ in range(2):
        append_events(events, f"file://{tmp_path}/log", "warn")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2


def test_dedup_key(spark):
    import hashlib

    got = spark.range(1).select(dedup_key(F.lit("page_fetch"), F.lit("https://é")).alias("k")).first().k
    assert got == hashlib.sha256("page_fetch:https://é".encode()).hexdigest()


def test_reverified_counts_catalogs_without_domain(spark):
    catalogs = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "id bigint, domain_id bigint")
    verified = spark.createDataFrame([(1, "invalid"), (2, "valid"), (3, "invalid"), (4, "invalid")], "catalog_id bigint, verdict string")
    domains = spark.createDataFrame([(1,)], "id bigint")
    assert tuple(reports.reverified(catalogs, domains, verified).first()) == (4, 1)
    assert tuple(reports.reverified(catalogs.limit(0), domains, verified).first()) == (0, 0)
