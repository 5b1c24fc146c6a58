import json
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from wharfside.plans import crawl
from wharfside.schemas import RESPONSES

pytestmark = pytest.mark.slow
NOW = datetime(2026, 3, 1)
PAGE = "text/html; charset=utf-8"


def _entry(host, name, kind="application/ai-skill", **more):
    return {"identifier": f"urn:air:{host}:{name}", "displayName": name, "type": kind, "representativeQueries": ["a", "b"], **({"url": f"https://{host}/{name}"} if not more else more)}


def _catalog(*entries):
    return json.dumps({"specVersion": "1.0", "host": {"displayName": "X"}, "entries": list(entries)}).encode()


def _run(spark, seeds, rows, pages=None, **cfg):
    responses = spark.createDataFrame([(u, u, s, c, bytearray(b), None) for u, s, c, b in rows], RESPONSES)
    state = crawl.start(spark, spark.createDataFrame([(x, i) for i, x in enumerate(seeds)], "raw string, ord bigint"), NOW)
    return crawl.crawl(state, responses, NOW, crawl.Config(**cfg), pages, most_steps=12)


def test_full_chain(spark):
    inner = {"specVersion": "1.0", "entries": [_entry("b.test", "nested")]}
    root = _catalog(
        _entry("b.test", "skill"), _entry("b.test", "card", "application/mcp-server-card+json"), _entry("b.test", "more", "application/ai-catalog+json", data=inner),
        _entry("b.test", "reg", "application/ai-registry+json", url="https://r.test"),
    )
    rows = [
        ("https://a.test/", 200, PAGE, b'<a href="https://b.test/x">b</a>'),
        ("https://b.test/.well-known/ai-catalog.json", 200, "application/json", root),
        ("https://b.test/robots.txt", 404, "", b""),
        ("https://b.test/skill", 200, "text/markdown", b"# skill"),
        ("https://b.test/card", 200, "application/json", b"{}"),
        ("https://b.test/nested", 404, "", b""),
    ]
    result = "array<struct<urn:string,display_name:string,media_type:string,ref_url:string>>"
    pages = spark.createDataFrame(
        [
            ("https://r.test", "", 200, [("urn:air:c.test:one", "one", "application/ai-skill", "https://c.test/1")], [], "t2"),
            ("https://r.test", "t2", 200, [("urn:air:c.test:two", "two", "application/ai-skill", "https://c.test/2")], [("", "other", "", "https://s.test")], ""),
            ("https://s.test", "", 200, [("urn:air:d.test:three", "three", "application/ai-skill", "https://d.test/3")], [], ""),
        ],
        f"base_url string, page_token string, status int, results {result}, referrals {result}, next_token string",
    )
    state = _run(spark, ["https://a.test/"], rows, pages, max_depth=0, max_attempts=1)
    host = state["domains"].filter("host = 'b.test'").first()
    assert host.ard_status == "found_valid" and host.discovery_source == "anchor"
    probes = {r.method: r.outcome for r in state["probes"].filter(F.col("domain_id") == host.id).collect()}
    assert probes == {"well_known": "hit", "robots_agentmap": "miss"}
    catalogs = {r.source_url: r for r in state["catalogs"].collect()}
    assert len(catalogs) == 2
    nested = catalogs["https://b.test/.well-known/ai-catalog.json#urn:air:b.test:more"]
    assert nested.parent_catalog_id == catalogs["https://b.test/.well-known/ai-catalog.json"].id
    assert state["entries"].filter("source = 'catalog'").count() == 5
    registry = state["entries"].filter("source = 'registry'").collect()
    assert {r.urn for r in registry} == {"urn:air:c.test:one", "urn:air:c.test:two", "urn:air:d.test:three"}
    assert {r.catalog_id for r in registry} == {nested.parent_catalog_id}
    regs = sorted((r.base_url, r.harvest_status, r.referral_source_id) for r in state["registries"].collect())
    assert [(b, s) for b, s, _ in regs] == [("https://r.test", "ok"), ("https://s.test", "ok")] and regs[1][2] is not None
    assert sorted(r.fetch_status for r in state["artifacts"].collect()) == ["error", "ok", "ok"]


def test_invalid_stored_unchanged_skipped_and_budget(spark):
    bad = _catalog({"identifier": "nope", "displayName": "x", "type": "text/plain", "url": "https://e.test/u", "data": {}})
    rows = [
        ("https://e.test/", 200, PAGE, "".join(f'<a href="/p{i}">x</a>' for i in range(8)).encode()),
        ("https://e.test/.well-known/ai-catalog.json", 200, "application/json", bad),
    ]
    rows += [(f"https://e.test/p{i}", 200, PAGE, b"<p>end</p>") for i in range(8)]
    state = _run(spark, ["https://e.test/"], rows, max_pages_per_host=4, fetch_artifacts=False, max_attempts=1)
    assert state["domains"].filter("host = 'e.test'").first().ard_status == "found_invalid"
    assert state["entries"].count() == 1
    assert state["frontier"].filter("kind = 'page_fetch'").count() == 4
    again = crawl.fr.enqueue(state["frontier"], crawl.fr.items(crawl.seed_items(spark.createDataFrame([("e.test", 0)], "raw string, ord bigint"))), F.lit(NOW))
    state["frontier"] = again
    responses = spark.createDataFrame([(u, u, s, c, bytearray(b), None) for u, s, c, b in rows], RESPONSES)
    later = crawl.crawl(state, responses, datetime(2026, 4, 1), crawl.Config(fetch_artifacts=False, max_attempts=1), most_steps=4)
    assert later["catalogs"].count() == 1
