"""Scalar functions and verification: tables of inputs and expected outputs."""

import json

import pytest
from pyspark.sql import functions as F

from wharfside import config
from wharfside.functions import exporttext, hosts, media, urns
from wharfside.functions.links import agentmap_urls, extract_links, resolve_http_url, robots_allow
from wharfside.functions.slices import list_items, object_members
from wharfside.operators import verify


def _map(spark, values, column, kind="string"):
    """column(F.col('x')) over values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hosts(spark):
    raw = ["*.Example.COM.", " a.b ", "localhost", "10.0.0.1", "a_b.com", "a.com:80", "-a.com", "x" * 64 + ".com", "", None, "é.com", "a..b"]
    assert _map(spark, raw, hosts.sanitize_host) == ["example.com", "a.b", *[None] * 10]
    assert _map(spark, ["http://u@h.test:81/p", "nope", None], hosts.host_of) == ["h.test:81", None, None]
    assert _map(spark, ["http://u@h.test:81/p", "https://x?y", ""], hosts.url_host) == ["h.test", "x", None]
    assert [s % 10 for s in _map(spark, ["site1.test", "site8.test", "site3.test", "site11.test"], hosts.host_shard)] == [9, 0, 3, 2]
    assert _map(spark, ["com.Acme/server", "acme/x", "noslash"], hosts.domain_of_reverse_dns) == ["acme.com", None, None]
    assert _map(spark, ["a.b.co.uk", "co.uk", "b.x.com", "com"], hosts.registrable_domain) == ["b.co.uk", None, "x.com", None]
    text = "see https://gist.github.com/a and (https://p.example/x) <http://me.github.io>"
    assert _map(spark, [text, None], hosts.hosts_of_text) == [["p.example", "me.github.io"], None]


def test_media(spark):
    def all_of(c):
        m = media.parse_media(c)
        return F.concat_ws("|", media.full_type(m), m["suffix"], media.media_kind(m), media.media_format(m), media.profile(m))

    given = ["Application/MCP-Server-Card+JSON", "garbage", "text/markdown; charset=utf-8", 'application/zip; Profile="urn:air:agent-skills"', "application/ai-catalog+json;profile=urn:air:agent-skills", "", None, "a/b+c+gzip; p=1; P=2"]
    assert _map(spark, given, all_of) == [
        "application/mcp-server-card|json|mcp-server|json|", "/garbage||unknown|unknown|", "text/markdown||generic|markdown|", "application/zip||skill|unknown|urn:air:agent-skills",
        "application/ai-catalog|json|catalog|json|urn:air:agent-skills", "/||unknown|unknown|", "/||unknown|unknown|", "a/b+c|gzip|unknown|gzip|",
    ]


def test_urns(spark):
    def text(c):
        return urns.urn_text(urns.parse_urn(urns.with_ascii_publisher(c)))

    given = ["urn:air:Acme.Example:ns:Name", "URN:AI:a.b:n", "urn:air:acme:n", "urn:air:a.b", "urn:air:a.b::n", "urn:x:a.b:n", "urn:air:a b.c:n", "urn:air:café.example:n", "", None]
    assert _map(spark, given, text) == ["urn:air:acme.example:ns:Name", "urn:ai:a.b:n", None, None, None, None, None, "urn:air:xn--caf-dma.example:n", None, None]


def test_links():
    page = '<base href="/sub/"><a href="x#f">1</a><AREA HREF="//o.test/y"><a href="mailto:z"><a href="%zz"><a href="/sub/x"><link rel="x AI-Catalog" href="c.json"><a>'
    assert extract_links("https://h.test/p", page) == {"links": ["https://h.test/sub/x", "https://o.test/y"], "hosts": ["h.test", "o.test"], "hints": ["https://h.test/sub/c.json"]}
    assert extract_links("https://h.test:bad/", "<a href='x'>")["links"] == []
    assert extract_links("https://h.test/", None)["links"] == []
    assert resolve_http_url("https://h.test/a/b", "../c?q=1#f", strip_fragment=False) == "https://h.test/c?q=1#f"
    assert agentmap_urls("# x\nAGENTMAP: /a.json#1\nagentmap:\nAgentmap: https://o.test/b\nAgentmap: /a.json#1", "https://h.test/robots.txt") == ["https://h.test/a.json#1", "https://o.test/b"]
    robots = "User-agent: *\nDisallow: /no"
    assert robots_allow(robots, "https://h.test/yes", "w") and not robots_allow(robots, "https://h.test/no/x", "w") and robots_allow(None, "https://h.test/no", "w")


def test_export_text(spark):
    nasty = ['a"b\\c', "<x>&", "\n\r\t\b\f\x01\x1f", "  ", "é日😀", "", None]
    got = _map(spark, nasty, exporttext.json_string)
    assert got[1] == '"\\u003cx\\u003e\\u0026"' and got[3] == '"\\u2028\\u2029"'
    assert [json.loads(g) for g in got] == [x or "" for x in nasty]
    assert _map(spark, ["a,b", 'q"', " s", "\\.", "plain", "x\ny", None], exporttext.csv_field) == ['"a,b"', '"q"""', '" s"', '"\\."', "plain", '"x\ny"', ""]


def _entry(name, host="acme.example", **more):
    return {"identifier": f"urn:air:{host}:{name}", "displayName": "x", "type": "application/ai-skill", "url": "https://x", "representativeQueries": ["a", "b"]} | more


def _checks(spark, *documents, domain="acme.example"):
    texts = [d if d is None or isinstance(d, str) else json.dumps(d) for d in documents]
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id bigint, raw_json string, checks string")
    got = verify.verify_documents(rows, domain=F.lit(domain)).orderBy("catalog_id").collect()
    return [(r.verdict, {c.check_id for c in r.checks if not c.passed}, {c.check_id for c in r.checks}) for r in got]


def test_verify(spark):
    def doc(*entries, **more):
        return {"specVersion": "1.0", "entries": list(entries)} | more

    both = {**_entry("a"), "data": {}}
    got = _checks(
        spark, doc(_entry("a")), "{", None, doc(both), doc(_entry("a"), specVersion="2.0"), doc(_entry("a", "other.example", type="x/y")), doc(_entry("a"), _entry("A", "ACME.example"), _entry("a", "ACME.EXAMPLE")),
        doc(_entry("r", type="application/ai-registry+json", representativeQueries=["a", "b"])), doc(_entry("x", "café.example")), doc({**_entry("a"), "displayName": 5}), doc(extra=1), doc({**_entry("a"), "representativeQueries": ["one"]}),
    )
    assert got[0][:2] == ("valid", set())
    assert got[1][:2] == got[2][:2] == ("invalid", {"schema.parse"})
    assert got[3][:2] == ("invalid", {"schema.validation"})
    assert got[4][0] == "invalid" and not got[4][2] & {"catalog.spec_version", "entry.value_or_reference", "urn.format"} and {"identifier.unique", "urn.publisher_matches", "entry.media_type"} <= got[4][2]
    assert got[5][:2] == ("valid_with_warnings", {"urn.publisher_matches", "entry.media_type"})
    assert "identifier.unique" in got[6][1]
    assert "queries.count" not in got[7][2] and got[7][0] == "valid"
    assert "schema.validation" not in got[8][1]
    assert got[9][2] == {"schema.validation"}
    assert got[10][1] == {"schema.validation"}
    assert got[11][1] == {"schema.validation", "queries.count"}


def test_slices():
    text = '{ "a" : [1, {"b":2} ] , "c": {"d" : 1.50} }'
    assert [(k, w) for k, _, w in object_members(text)] == [("a", '[1, {"b":2} ]'), ("c", '{"d" : 1.50}')]
    assert [w for _, w in list_items('[1, {"b":2} ]')] == ["1", '{"b":2}']


def test_config():
    assert config.load_text('{"crawler": {"maxDepth": 0.0}}')["crawler"]["maxDepth"] == 0
    for bad, said in (('{"x": 1}', "config.x: unknown member"), ('{"registry": {"harvest": 1}}', "config.registry.harvest: expected boolean"), ('{"worker": {"index": 1}}', "below count")):
        with pytest.raises(ValueError, match=said):
            config.load_text(bad)
