import json
from datetime import datetime

import pytest

from wharfside.plans import crawl
from wharfside.schemas import RESPONSES
from wharfside.streaming import responses

pytestmark = pytest.mark.slow
NOW = datetime(2026, 3, 1)
RESULTS = "array<struct<urn:string,display_name:string,media_type:string,ref_url:string>>"
PAGES = f"base_url string, page_token string, status int, results {RESULTS}, referrals {RESULTS}, next_token string"


def _entry(name, kind="application/ai-skill", url=None):
    return {"identifier": f"urn:air:b.test:{name}", "displayName": name, "type": kind, "representativeQueries": ["a", "b"], "url": url or f"https://b.test/{name}"}


ROOT = json.dumps({"specVersion": "1.0", "host": {"displayName": "X"}, "entries": [_entry("skill"), _entry("card"), _entry("private"), _entry("reg", "application/ai-registry+json", "https://r.test")]}).encode()
CATALOG = ("https://b.test/.well-known/ai-catalog.json", 200, "application/json", ROOT)
SKILL = ("https://b.test/skill", 200, "text/markdown", b"# skill")
OF_A = [
    ("https://a.test/", 200, "text/html", b'<a href="https://b.test/x">b</a>'),
    ("https://a.test/robots.txt", 404, "", b""),
    ("https://a.test/.well-known/ai-catalog.json", 404, "", b""),
]
RULES = ("https://b.test/robots.txt", 200, "text/plain", b"User-agent: *\nDisallow: /private\n")
FIRST = ("https://r.test", "", 200, [("urn:air:c.test:one", "one", "application/ai-skill", "https://c.test/1")], [], "t2")
SECOND = ("https://r.test", "t2", 200, [("urn:air:c.test:two", "two", "application/ai-skill", "https://c.test/2")], [], "")


def _start(spark):
    return crawl.start(spark, spark.createDataFrame([("https://a.test/", 0)], "raw string, ord bigint"), NOW)


def _stream(spark, folder, checkpoint, state, pages):
    kept = [state]
    query = responses.crawl_stream(
        spark, str(folder), str(checkpoint), state, crawl.Config(max_depth=0), lambda: NOW, kept.append, lambda: spark.createDataFrame(pages, PAGES)
    )
    query.awaitTermination()
    return kept[-1]


def _arrive(spark, folder, rows):
    spark.createDataFrame([(u, u, s, c, bytearray(b), None) for u, s, c, b in rows], RESPONSES).coalesce(1).write.mode("append").parquet(str(folder))


def _items(state):
    return {(r.kind, r.url or r.host): (r.status, r.attempts) for r in state["frontier"].collect()}


def _status(state):
    return {r.host: r.ard_status for r in state["domains"].collect()}


def test_responses_in_wrong_order(spark, tmp_path):
    folder, checkpoint = tmp_path / "responses", tmp_path / "checkpoint"
    _arrive(spark, folder, [CATALOG, SKILL])
    state = _stream(spark, folder, checkpoint, _start(spark), [FIRST])
    assert _items(state) == {("page_fetch", "https://a.test/"): ("pending", 0), ("host_probe", "a.test"): ("pending", 0)}
    _arrive(spark, folder, OF_A)
    state = _stream(spark, folder, checkpoint, state, [FIRST])
    assert _status(state) == {"a.test": "not_found", "b.test": "unprobed"}
    assert _items(state)["host_probe", "b.test"] == ("pending", 0)  # its robots.txt is still to come
    _arrive(spark, folder, [RULES, ("https://b.test/card", 503, "", b"")])
    state = _stream(spark, folder, checkpoint, state, [FIRST])
    assert _status(state)["b.test"] == "found_valid"
    items = _items(state)
    assert items["artifact_fetch", "https://b.test/skill"] == ("done", 0)
    assert items["artifact_fetch", "https://b.test/private"] == ("done", 0)  # disallowed: closed without a response
    assert items["artifact_fetch", "https://b.test/card"] == ("pending", 1)  # one answer, one attempt
    assert items["registry_harvest", "https://r.test"] == ("pending", 0)  # its second page is still to come
    _arrive(spark, folder, [("https://b.test/card", 200, "application/json", b"{}")])
    state = _stream(spark, folder, checkpoint, state, [FIRST, SECOND])
    assert {s for s, _ in _items(state).values()} == {"done"}
    assert sorted((r.url, r.fetch_status) for r in state["artifacts"].collect()) == [("https://b.test/card", "ok"), ("https://b.test/skill", "ok")]
    assert sorted(r.urn for r in state["entries"].filter("source = 'registry'").collect()) == ["urn:air:c.test:one", "urn:air:c.test:two"]
    assert [r.harvest_status for r in state["registries"].collect()] == ["ok"]
    assert state["catalogs"].count() == 1 and state["probes"].filter("outcome = 'error'").count() == 0


def test_one_batch_runs_the_whole_chain(spark, tmp_path):
    folder = tmp_path / "responses"
    for rows in ([CATALOG], [SKILL, ("https://b.test/card", 404, "", b"")], OF_A, [RULES]):
        _arrive(spark, folder, rows)
    state = _stream(spark, folder, tmp_path / "checkpoint", _start(spark), [FIRST, SECOND])
    assert {s for s, _ in _items(state).values()} == {"done"}
    assert state["entries"].count() == 6 and state["artifacts"].count() == 2
