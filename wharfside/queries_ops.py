"""Registered queries of sources, frontier, store, probes and verification, each over whole tables, with the SQL to check them against.

Payloads that the tables don't hold (rank lines, robots files, search records)
are written from the columns of a table, row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside.functions import hosts, links, media, urns
from wharfside.operators import export, frontier, reports, store, verify
from wharfside.plans import crawl, jobs
from wharfside.queries_index import _FRONTIER_SQL, _frontier
from wharfside.scratch import scratch_root, write_table
from wharfside.sources import registry, seeds
from wharfside.streaming import responses as stream
from wharfside.tables import EXPORT_FIELDS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2026, 3, 1)
_AT = "TIMESTAMP '2026-03-01 00:00:00'"


def query(sql: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- seed sources -------------------------------------------------------------------------------


@query("""WITH l AS (SELECT id, unnest([host, 'b.' || host]) AS raw, unnest([1, 3]) AS line FROM domains)
SELECT 'first.example' AS raw, CAST(0 AS BIGINT) AS ord UNION ALL SELECT raw, row_number() OVER (ORDER BY lpad(CAST(id AS VARCHAR), 12, '0'), line) FROM l""")
def seed_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# list\n  "), F.col("host"), F.lit(" \n\r\nb."), F.col("host"), F.lit("\n"))
    lists = table(spark, d, "domains").select(F.lpad(F.col("id").cast("string"), 12, "0").alias("path"), text.alias("text"))
    return seeds.listed_seeds(spark, lists, ["first.example"]).withColumn("ord", F.col("ord").cast("long"))


@query("""WITH l AS (SELECT id, host FROM domains WHERE id % 5 <> 0 AND id > (SELECT max(id) FROM domains) - 40), n AS (SELECT id, unnest([host, 'www.' || host]) AS host, unnest([0, 1]) AS pos FROM l),
f AS (SELECT host, min(id * 2 + pos) AS k FROM n GROUP BY host) SELECT host, k // 2 AS index, CAST(k % 2 AS INTEGER) AS pos FROM f ORDER BY k LIMIT 40""")
def ct_window(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.concat(F.lit("*."), F.col("host")), F.concat(F.lit("WWW."), F.col("host")))
    leaves = table(spark, d, "domains").select(F.lit("log").alias("log"), F.col("id").alias("index"), names.alias("names"), (F.col("id") % 5 != 0).alias("parsed"))
    return seeds.ct_names(leaves, ["log"], 40).select("host", "ord.index", "ord.pos")


_LOGS = "SELECT 'Op' || id % 7 AS operator, 'log ' || id AS description, 'https://' || host || '/' AS url, id % 4 <> 0 AS usable, id AS ord, CASE WHEN id % 6 = 0 THEN NULL ELSE TIMESTAMP '2026-01-01' + to_days(CAST(id % 500 AS INTEGER)) END AS a FROM domains"


@query(f"""WITH l AS (SELECT *, a + INTERVAL 90 DAY AS b FROM ({_LOGS}) WHERE usable AND (lower(operator) LIKE '%op1%' OR lower(operator) LIKE '%op3%')),
c AS (SELECT operator, 0 AS later, ord, url FROM l WHERE a IS NULL OR (a <= {_AT} AND {_AT} < b)),
n AS (SELECT operator, 1 AS later, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY a, ord) AS rn FROM l WHERE a > {_AT} AND a <= {_AT} + INTERVAL 400 DAY) WHERE rn = 1)
SELECT ord, url FROM (SELECT * FROM c UNION ALL SELECT * FROM n)""")
def ct_logs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    start = F.when(i % 6 != 0, F.to_timestamp(F.lit("2026-01-01")) + F.make_interval(days=(i % 500).cast("int")))
    logs = table(spark, d, "domains").select(F.concat(F.lit("Op"), i % 7).alias("operator"), F.concat(F.lit("log "), i).alias("description"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), (i % 4 != 0).alias("usable"), i.alias("ord"), start.alias("start"))
    return seeds.need_ct_logs(logs.withColumn("end", F.col("start") + F.make_interval(days=F.lit(90))), ["op1", "OP3"], F.lit(NOW))


@query("""WITH r AS (SELECT CAST(id % 3 AS INTEGER) AS query, id AS idx, unnest([host, 'a.' || host, 'b.' || host]) AS host, unnest([0, 1, 2]) AS pos FROM domains)
SELECT host, arg_min(query, [query, idx, pos]) AS query, arg_min(idx, [query, idx, pos]) AS idx, CAST(min(pos) AS INTEGER) AS pos FROM r GROUP BY host""")
def crtsh_hosts(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat(F.lit("*.A."), F.col("host"), F.lit("\nb."), F.col("host"), F.lit("\nnot a name"))
    records = table(spark, d, "domains").select((F.col("id") % 3).cast("int").alias("query"), F.col("id").alias("idx"), F.col("host").alias("common_name"), names.alias("name_value"))
    return seeds.crtsh_names(records).select("host", "ord.query", "ord.idx", "ord.pos")


@query("""SELECT host, min(id) AS ord FROM (SELECT id, CASE WHEN id % 3 = 0 THEN host WHEN id % 3 = 1 THEN 'own' || id || '.github.io' END AS host FROM domains) WHERE host IS NOT NULL GROUP BY host""")
def repository_hosts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    owner = F.concat(F.lit("Own"), i)
    full = F.when(i % 3 == 1, F.concat(owner, F.lit("/own"), i, F.lit(".GitHub.io"))).otherwise(F.concat(owner, F.lit("/tool")))
    home = F.when(i % 3 == 0, F.concat(F.lit(" https://"), "host", F.lit(":8443/x "))).when(i % 3 == 1, "")
    return seeds.repository_hosts(table(spark, d, "domains").select(i.alias("ord"), full.alias("full_name"), home.alias("homepage")))


@query("""WITH s AS (SELECT id, unnest(CASE WHEN id % 2 = 0 THEN ['mcp.' || host, host] ELSE ['mcp.' || host] END) AS host, unnest(CASE WHEN id % 2 = 0 THEN [0, 1] ELSE [0] END) AS pos FROM domains)
SELECT host, min(id) AS ord, CAST(min(pos) AS INTEGER) AS pos FROM s GROUP BY host""")
def server_hosts(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("id") % 2 == 0, F.concat(hosts.reverse_host(F.col("host")), F.lit("/Server"))).otherwise("plain")
    servers = table(spark, d, "domains").select(F.col("id").alias("ord"), name.alias("name"), F.array(F.concat(F.lit("https://mcp."), "host", F.lit("/sse")), F.lit("none")).alias("remotes"))
    return seeds.server_hosts(servers).select("host", "ord.ord", "ord.pos")


_INFRA = ", ".join(f"'{x}'" for x in hosts.INFRA_DOMAINS)


@query(f"""WITH u AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, 'https?://[^\\s<>"'')\\]]+'), lambda x: lower(regexp_extract(x, '://(?:[^/@?#]*@)?([^/:?#]*)', 1))), lambda h: h <> '') AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, unnest(l) AS host, generate_subscripts(l, 1) AS pos FROM u)
SELECT host, min(doc_id) AS ord FROM h WHERE array_to_string(string_split(host, '.')[-2:], '.') NOT IN ({_INFRA}) AND regexp_full_match(host, '[a-z0-9]([a-z0-9-]*[a-z0-9])?([.][a-z0-9]([a-z0-9-]*[a-z0-9])?)+') GROUP BY host""")
def curated_hosts(spark: SparkSession, d: str) -> DataFrame:
    return seeds.curated_hosts(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")).select("host", F.col("ord.ord").alias("ord"))


@query("SELECT id, 'rel-' || id AS release FROM domains")
def newest_releases(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "domains").select("id", F.concat(F.lit('[{"id":"rel-'), "id", F.lit('","x":1},{"id":"old"}]')).alias("releases"))
    return listed.select("id", seeds.newest_release(listed).alias("release"))


@query("""SELECT id, 'https://' || host || CASE WHEN id % 3 = 2 THEN '/v1/search' ELSE '/search' END AS url FROM domains""")
def search_endpoints(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://"), "host", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "/").otherwise("/v1/search/"))
    return table(spark, d, "domains").select("id", seeds.search_url(base).alias("url"))


@query("""WITH n AS (SELECT id, host, 1 + id % 4 AS pages FROM domains)
SELECT 'https://' || host AS base_url, CAST(p AS INTEGER) AS page_no, CAST(CASE WHEN id % 7 = 0 AND p = 2 THEN 501 ELSE 200 END AS INTEGER) AS status FROM n, unnest(generate_series(1, pages)) AS t(p) WHERE NOT (id % 7 = 0 AND p > 2) AND p <= 3""")
def registry_walks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    numbered = table(spark, d, "domains").select("id", F.concat(F.lit("https://"), "host").alias("base_url"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + i % 4)).alias("p"))
    token = F.when(F.col("p") == 1, "").otherwise(F.concat(F.lit("t"), F.col("p")))
    after = F.when(F.col("p") == 1 + i % 4, F.when(i % 3 == 0, "").otherwise("t1")).otherwise(F.concat(F.lit("t"), F.col("p") + 1))
    pages = numbered.select("base_url", token.alias("page_token"), F.when((i % 7 == 0) & (F.col("p") == 2), 501).otherwise(200).alias("status"), after.alias("next_token"))
    return registry.harvest(pages.select("base_url"), pages, page_limit=3)


@query("SELECT doc_id, NOT (starts_with(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/' || substr(host, 1, 1)) OR doc_id % 11 = 0) AS allowed FROM documents")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /"), F.substring("host", 1, 1), F.lit("\n"))
    rules = F.when(F.col("doc_id") % 11 == 0, "User-agent: wharfside\nDisallow: /\n").otherwise(rules)
    return table(spark, d, "documents").select("doc_id", links.robots_allow_udf(rules, F.col("url"), F.lit("wharfside")).alias("allowed"))


@query("""SELECT id, unnest(['https://' || host || '/a.json', 'https://cat.' || host || '/b.json#x']) AS url FROM domains""")
def agentmaps(spark: SparkSession, d: str) -> DataFrame:
    host = F.col("host")
    raw = F.concat(F.lit("User-agent: *\nAgentmap: /a.json\n# agentmap: /no.json\nAGENTMAP:  https://cat."), host, F.lit("/b.json#x \nagentmap: https://"), host, F.lit("/a.json\nagentmap: ftp://x/\n"))
    return table(spark, d, "domains").select("id", F.explode(links.agentmap_urls_udf(raw, F.concat(F.lit("https://"), host, F.lit("/robots.txt")))).alias("url"))


@query("""WITH p AS (SELECT doc_id, unnest(['https://' || host || '/dir/child', 'https://' || host || '/top']) AS link, 'https://' || host || '/c.json' AS hint FROM documents) SELECT doc_id, link, hint FROM p""")
def based_links(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("<head><base href='https://"), "host", F.lit("/dir/'><base href='https://late.example/'><link rel='Alternate AI-Catalog' href='/c.json'>"))
    page = F.concat(base, F.lit("</head><a href='child#frag'>c</a><area href='/top'><a href='javascript:x()'>j</a><a href='http://%zz/'>bad</a>"))
    rows = table(spark, d, "documents").select("doc_id", links.extract_links_udf(F.lit("https://elsewhere.example/"), page).alias("l"))
    return rows.select("doc_id", F.explode("l.links").alias("link"), F.get("l.hints", F.lit(0)).alias("hint"))


# --- scalar functions ---------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) ELSE host END AS fetch_host, doc_id % 3 <> 2 AS is_json, CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/x-JSON' ELSE 'unknown' END AS bare, doc_id % 5 < 2 AS is_rel FROM documents""")
def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ct = F.when(i % 3 == 0, "application/json; charset=utf-8").when(i % 3 == 1, "text/x-JSON").otherwise(" ; q=1")
    rel = F.when(i % 5 == 0, "ai-catalog").when(i % 5 == 1, "alternate\tAI-Catalog").otherwise("ai-catalogs alternate")
    return table(spark, d, "documents").select("doc_id", hosts.fetch_host(F.when(i % 2 == 0, F.col("url")).otherwise("/rel"), F.col("host")).alias("fetch_host"), hosts.is_json_content_type(ct).alias("is_json"), hosts.bare_content_type(ct).alias("bare"), hosts.is_catalog_rel(rel).alias("is_rel"))


@query("""SELECT id, array_to_string(list_reverse(string_split(host, '.')), '.') || '/Tool' AS name, host AS domain FROM domains""")
def reverse_dns_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(hosts.reverse_host(F.col("host")), F.lit("/Tool"))
    return table(spark, d, "domains").select("id", name.alias("name"), hosts.domain_of_reverse_dns(name).alias("domain"))


@query("""SELECT id, CASE WHEN coalesce(urn_publisher, '') = '' THEN NULL ELSE lower(regexp_extract(urn, '^([a-zA-Z]+:[a-zA-Z]+:)', 1)) || urn_publisher || ':' || CASE WHEN urn_namespace = '' THEN '' ELSE urn_namespace || ':' END || urn_name END AS urn FROM catalog_entries""")
def urn_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_entries").select("id", urns.urn_text(urns.parse_urn(F.coalesce("urn", F.lit("")))).alias("urn"))


@query("""SELECT id, 'urn:air:xn--bcher-kva.' || host || ':x' AS urn FROM domains""")
def idn_publishers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domains").select("id", urns.with_ascii_publisher(F.concat(F.lit("urn:air:Bücher."), F.col("host"), F.lit(":x"))).alias("urn"))


@query("""SELECT e.id, coalesce(lower(e.urn_publisher) = lower(d.host) OR (array_to_string(string_split(lower(e.urn_publisher), '.')[-2:], '.') = array_to_string(string_split(lower(d.host), '.')[-2:], '.') AND e.urn_publisher LIKE '%.%'), false) AS own
FROM catalog_entries e JOIN ard_catalogs c ON e.catalog_id = c.id JOIN domains d ON c.domain_id = d.id""")
def publisher_matches(spark: SparkSession, d: str) -> DataFrame:
    e, c, own = table(spark, d, "catalog_entries").select("id", "catalog_id", "urn_publisher"), table(spark, d, "ard_catalogs").select(F.col("id").alias("catalog_id"), "domain_id"), table(spark, d, "domains").select(F.col("id").alias("domain_id"), "host")
    return e.join(c, "catalog_id").join(own, "domain_id").select("id", hosts.registrable_equal(F.col("urn_publisher"), F.col("host")).alias("own"))


_POINTER = "lower(trim(split_part(coalesce(media_type, ''), ';', 1)))"


@query(f"""SELECT id, regexp_matches({_POINTER}, '^application/(ai-catalog|ai-registry)([+][^+]*)?$') AS pointer, CASE WHEN id % 2 = 0 THEN 'urn:air:agent-skills' ELSE '' END AS profile,
CASE WHEN regexp_matches({_POINTER}, '^application/(ai-catalog)([+][^+]*)?$') THEN 'catalog' WHEN regexp_matches({_POINTER}, '^application/(ai-registry)([+][^+]*)?$') THEN 'registry' WHEN id % 2 = 0 THEN 'skill' ELSE 'other' END AS kind FROM catalog_entries""")
def media_profiles(spark: SparkSession, d: str) -> DataFrame:
    bare = F.substring_index(F.coalesce("media_type", F.lit("")), ";", 1)
    m = media.parse_media(F.when(F.col("id") % 2 == 0, F.concat(bare, F.lit('; Profile="x"; profile="urn:air:agent-skills"'))).otherwise(bare))
    kind = media.media_kind(m)
    return table(spark, d, "catalog_entries").select("id", media.is_pointer(m).alias("pointer"), media.profile(m).alias("profile"), F.when(kind.isin("catalog", "registry", "skill") & ((F.col("id") % 2 == 0) | (kind != "skill")), kind).otherwise("other").alias("kind"))


# --- frontier -----------------------------------------------------------------------------------


@query(f"""SELECT id, CASE WHEN id % 8 = 1 THEN 'done' ELSE status END AS status, CASE WHEN id % 8 = 1 THEN '' ELSE 'w' END AS worker, id % 4 = 1 AND id % 8 <> 1 AS leased FROM ({_FRONTIER_SQL})""")
def complete_items(spark: SparkSession, d: str) -> DataFrame:
    items = _frontier(spark, d)
    after = frontier.complete(items, items.filter("id % 8 IN (0, 1)").select("id"), F.lit(NOW), worker="w")
    return after.select("id", "status", F.col("worker_id").alias("worker"), F.col("leased_until").isNotNull().alias("leased"))


@query(f"""SELECT id, CASE WHEN id % 8 = 5 THEN 'pending' ELSE status END AS status, attempts FROM ({_FRONTIER_SQL})""")
def requeue_items(spark: SparkSession, d: str) -> DataFrame:
    items = _frontier(spark, d)
    return frontier.requeue(items, items.filter("id % 8 IN (2, 5)").select("id"), F.lit(NOW)).select("id", "status", "attempts")


@query(f"""WITH f AS ({_FRONTIER_SQL}), t AS (SELECT id FROM f WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 150)
SELECT f.id, CASE WHEN t.id IS NOT NULL THEN 'in_flight' ELSE status END AS status, CASE WHEN t.id IS NOT NULL THEN 'me' ELSE 'w' END AS worker, CASE WHEN t.id IS NOT NULL THEN {_AT} + INTERVAL 60 SECOND ELSE leased_until END AS leased_until FROM f LEFT JOIN t ON f.id = t.id""")
def leased_snapshot(spark: SparkSession, d: str) -> DataFrame:
    after = frontier.dequeue(_frontier(spark, d), 150, F.lit(NOW), worker="me", lease_seconds=60)[1]
    return after.select("id", "status", F.col("worker_id").alias("worker"), F.col("leased_until").cast("timestamp_ntz").alias("leased_until"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query(f"""SELECT id FROM ({_FRONTIER_SQL}) WHERE status = 'pending' AND ({_FNV} % 8192) % 4 = 1""")
def shard_items(spark: SparkSession, d: str) -> DataFrame:
    items = _frontier(spark, d)
    return frontier.ready(items, shard=(1, 4)).select("id")


@query(f"""SELECT id, CASE WHEN status = 'in_flight' THEN 'held' ELSE 'lease_lost' END AS outcome FROM ({_FRONTIER_SQL}) UNION ALL SELECT -doc_id - 1, 'not_found' FROM documents""")
def lease_owners(spark: SparkSession, d: str) -> DataFrame:
    items = _frontier(spark, d)
    return frontier.ownership(items, items.select("id").unionByName(items.select((-F.col("id") - 1).alias("id"))), "w")


@query(f"""SELECT id, {_AT} + to_microseconds(500000 * (row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) ORDER BY id) - 1)) AS not_before FROM ({_FRONTIER_SQL})""")
def due_times(spark: SparkSession, d: str) -> DataFrame:
    return frontier.due_times(_frontier(spark, d), F.lit(NOW), per_second=2.0).select("id", F.col("not_before").cast("timestamp_ntz").alias("not_before"))


@query("SELECT host, count(DISTINCT doc_id % 3) AS workers FROM documents WHERE doc_id % 3 <> 0 GROUP BY host HAVING count(DISTINCT doc_id % 3) > 1")
def shared_hosts(spark: SparkSession, d: str) -> DataFrame:
    worker = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("w"), F.col("id") % 3))
    return frontier.shared_hosts(_frontier(spark, d).withColumn("worker_id", worker))


@query(f"SELECT id, least(30.0, CAST(pow(2, greatest(attempts - 1, 0)) AS DOUBLE)) AS wait, (attempts = 2) AS transient FROM ({_FRONTIER_SQL})")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("attempts") == 2, 503).otherwise(404)
    return _frontier(spark, d).select("id", store.backoff_seconds(F.col("attempts")).alias("wait"), store.is_transient(status, F.lit(None).cast("string")).alias("transient"))


# --- store, probes and summaries ------------------------------------------------------------------

_PROBES_SQL = """SELECT d.id AS domain_id, p.doc_id, p.fetched_at AS probed_at, CASE CAST(p.doc_id % 4 AS INTEGER) WHEN 0 THEN 'ok' WHEN 1 THEN 'miss' ELSE 'error' END AS outcome FROM documents p JOIN domains d ON p.host = d.host"""


def _probes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 4 == 0, 200).when(i % 4 == 1, 429).when(i % 4 == 2, 500).otherwise(0)
    rows = table(spark, d, "documents").join(table(spark, d, "domains").select(F.col("id").alias("domain_id"), "host"), "host")
    return rows.select("domain_id", "doc_id", "url", F.lit("well_known").alias("method"), F.col("fetched_at").alias("probed_at"), F.lit("").alias("error_detail"), store.classify_fetch(status, F.when(i % 4 == 3, "timeout")).alias("outcome"))


@query(f"SELECT domain_id, doc_id, outcome FROM ({_PROBES_SQL})")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _probes(spark, d).select("domain_id", "doc_id", "outcome")


@query(f"SELECT d.id, coalesce(p.t, d.last_probed_at) AS last_probed_at FROM domains d LEFT JOIN (SELECT domain_id, max(probed_at) AS t FROM ({_PROBES_SQL}) GROUP BY domain_id) p ON d.id = p.domain_id")
def recorded_probes(spark: SparkSession, d: str) -> DataFrame:
    return store.record_probes(table(spark, d, "domains"), _probes(spark, d)).select("id", "last_probed_at")


@query(f"SELECT count(*) FILTER (WHERE outcome = 'ok') AS hits, count(*) FILTER (WHERE outcome = 'miss') AS misses, count(*) FILTER (WHERE outcome = 'error') AS errors FROM ({_PROBES_SQL})")
def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.probe_summary(_probes(spark, d).withColumn("outcome", F.when(F.col("outcome") == "ok", "hit").otherwise(F.col("outcome"))))


@query(f"SELECT CASE WHEN outcome = 'error' THEN 'warn' ELSE 'info' END AS level, 'probe_' || outcome AS event, count(*) AS n FROM ({_PROBES_SQL}) WHERE outcome = 'error' GROUP BY outcome")
def probe_events(spark: SparkSession, d: str) -> DataFrame:
    events = stream.probe_events(_probes(spark, d).withColumn("outcome", F.when(F.col("outcome") == "ok", "hit").otherwise(F.col("outcome"))))
    return events.filter(stream.at_least(F.col("level"), "warn")).groupBy("level", "event").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN verification_status = 'invalid' THEN 'warn' ELSE 'info' END AS level, source_url || ' ' || verification_status || CASE WHEN id % 2 = 0 THEN ' failed' ELSE '' END AS detail FROM ard_catalogs""")
def catalog_events(spark: SparkSession, d: str) -> DataFrame:
    catalogs = table(spark, d, "ard_catalogs")
    return stream.catalog_events(catalogs, catalogs.filter("id % 2 = 0").select(F.col("id").alias("catalog_id"), F.lit("failed").alias("summary"))).select("level", "detail")


@query("SELECT d.id, coalesce(s.st, d.ard_status) AS ard_status FROM domains d LEFT JOIN (SELECT domain_id, arg_max(CASE WHEN verification_status = 'invalid' THEN 'found_invalid' ELSE 'found_valid' END, id) AS st FROM ard_catalogs GROUP BY domain_id) s ON d.id = s.domain_id")
def domain_statuses(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "domains")
    status = F.when(F.col("verification_status") == "invalid", "found_invalid").otherwise("found_valid")
    changes = table(spark, d, "ard_catalogs").select("domain_id", status.alias("ard_status"), F.col("id").alias("seq")).join(domains.select(F.col("id").alias("domain_id"), "host"), "domain_id")
    return store.update_status(domains, changes.select("host", "ard_status", "seq")).select("id", "ard_status")


@query("SELECT content_hash, arg_max(id, [epoch_us(fetched_at), id]) AS id FROM ard_catalogs GROUP BY content_hash")
def latest_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return frontier.latest(table(spark, d, "ard_catalogs").select("content_hash", "fetched_at", "id"), ["content_hash"], ["fetched_at", "id"]).select("content_hash", "id")


@query("SELECT id, catalog_id FROM catalog_entries WHERE catalog_id IN (SELECT id FROM ard_catalogs WHERE verification_status = 'invalid')")
def entries_of_invalid(spark: SparkSession, d: str) -> DataFrame:
    return store.of_keys(table(spark, d, "catalog_entries"), "catalog_id", table(spark, d, "ard_catalogs").filter("verification_status = 'invalid'").select("id")).select("id", "catalog_id")


@query("SELECT d.id, d.host, d.ard_status FROM domains d WHERE d.host = (SELECT host FROM documents ORDER BY doc_id LIMIT 1)")
def looked_up_domain(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").orderBy("doc_id").select("host").first()
    row = store.look_up(table(spark, d, "domains"), host=first.host)
    return spark.createDataFrame([(row.id, row.host, row.ard_status)], "id bigint, host string, ard_status string")


@query("SELECT c.id AS catalog_id, coalesce(e.id, -1) AS entry_id, e.source FROM ard_catalogs c LEFT JOIN catalog_entries e ON e.catalog_id = c.id")
def catalog_preload(spark: SparkSession, d: str) -> DataFrame:
    return jobs.entries_of_catalogs(table(spark, d, "ard_catalogs"), table(spark, d, "catalog_entries")).select("catalog_id", F.coalesce(F.col("entry.id"), F.lit(-1)).alias("entry_id"), F.col("entry.source").alias("source"))


_CHECKS_SQL = """SELECT 'catalog' AS subject_type, id AS subject_id, 'c.one' AS check_id, 'error' AS severity, id % 3 = 0 AS passed FROM ard_catalogs UNION ALL SELECT 'entry', id, 'e.one', 'warning', id % 2 = 0 FROM catalog_entries"""


def _checks(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name, kind, check, severity, k: table(spark, d, name).select(F.lit(kind).alias("subject_type"), F.col("id").alias("subject_id"), F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), (F.col("id") % k == 0).alias("passed"), F.lit("m").alias("message"))
    return of("ard_catalogs", "catalog", "c.one", "error", 3).unionByName(of("catalog_entries", "entry", "e.one", "warning", 2))


@query(f"""WITH c AS ({_CHECKS_SQL}), v AS (SELECT id FROM ard_catalogs WHERE id % 5 = 0)
SELECT subject_type, subject_id, check_id FROM c WHERE NOT (subject_type = 'catalog' AND subject_id IN (SELECT id FROM v)) AND NOT (subject_type = 'entry' AND subject_id IN (SELECT id FROM catalog_entries WHERE catalog_id IN (SELECT id FROM v)))
UNION ALL SELECT 'catalog', id, 'new' FROM v""")
def replaced_checks(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "ard_catalogs").filter("id % 5 = 0").select("id")
    fresh = ids.select(F.lit("catalog").alias("subject_type"), F.col("id").alias("subject_id"), F.lit("new").alias("check_id"), F.lit("error").alias("severity"), F.lit(True).alias("passed"), F.lit("").alias("message"))
    return store.replace_checks(_checks(spark, d), table(spark, d, "catalog_entries"), ids, fresh).select("subject_type", "subject_id", "check_id")


@query(f"""SELECT d.host, a.source_url, c.check_id, c.severity FROM ({_CHECKS_SQL}) c JOIN ard_catalogs a ON c.subject_type = 'catalog' AND c.subject_id = a.id JOIN domains d ON a.domain_id = d.id WHERE NOT c.passed AND a.verification_status = 'invalid'""")
def failing_of_invalid(spark: SparkSession, d: str) -> DataFrame:
    return store.failing_of_invalid(_checks(spark, d), table(spark, d, "ard_catalogs"), table(spark, d, "domains")).drop("message")


@query("""WITH m AS (SELECT catalog_id, urn, max(id) AS e FROM catalog_entries GROUP BY catalog_id, urn)
SELECT CAST(k.id AS BIGINT) AS id, CASE WHEN m.e IS NULL THEN 'catalog' ELSE 'entry' END AS subject_type, coalesce(m.e, k.catalog_id) AS subject_id FROM catalog_entries k LEFT JOIN m ON k.catalog_id = m.catalog_id AND (CASE WHEN k.id % 10 = 0 THEN 'unknown' ELSE k.urn END) = m.urn""")
def check_subjects(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "catalog_entries").select("id", "catalog_id", "urn")
    checks = entries.select("id", "catalog_id", F.when(F.col("id") % 10 == 0, "unknown").otherwise(F.col("urn")).alias("subject"))
    return verify.split_subjects(checks, entries).select("id", "subject_type", "subject_id")


@query("""SELECT count(*) AS reverified, count(*) FILTER (WHERE id % 2 = 0 AND domain_id % 9 <> 0) AS invalid FROM ard_catalogs""")
def reverified(spark: SparkSession, d: str) -> DataFrame:
    catalogs = table(spark, d, "ard_catalogs")
    verdicts = catalogs.select(F.col("id").alias("catalog_id"), F.when(F.col("id") % 2 == 0, "invalid").otherwise("valid").alias("verdict"))
    return reports.reverified(catalogs, table(spark, d, "domains").filter("id % 9 <> 0"), verdicts)


@query("""SELECT id, id % 3 = 0 AS content_type, strlen(raw_json) <= 4000 AS size, true AS utf8 FROM ard_catalogs WHERE raw_json IS NOT NULL""")
def transport_checks(spark: SparkSession, d: str) -> DataFrame:
    ct = F.when(F.col("id") % 3 == 0, "application/ai-catalog+json").otherwise("text/html")
    checks = verify.transport_checks(ct, F.col("raw_json").cast("binary"), 4000)
    return table(spark, d, "ard_catalogs").filter("raw_json IS NOT NULL").select("id", checks.alias("c")).select("id", F.col("c")[0]["passed"].alias("content_type"), F.col("c")[1]["passed"].alias("size"), F.col("c")[2]["passed"].alias("utf8"))


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 'invalid' WHEN id % 3 = 0 THEN 'valid_with_warnings' ELSE 'valid' END AS verdict FROM catalog_entries""")
def verdict_rollup(spark: SparkSession, d: str) -> DataFrame:
    one = lambda severity, passed: F.struct(F.lit(severity).alias("severity"), passed.alias("passed"))
    checks = F.array(one("error", F.lit(True)), one("warning", F.col("id") % 3 != 0), one("error", F.col("id") % 5 != 0))
    return table(spark, d, "catalog_entries").select("id", verify.verdict(checks).alias("verdict"))


@query("""SELECT (SELECT count(DISTINCT host) FROM documents) - (SELECT count(*) FROM domains WHERE id % 2 = 0 AND host IN (SELECT host FROM documents)) AS added, (SELECT count(*) FROM domains WHERE id % 2 = 0 AND host IN (SELECT host FROM documents)) AS skipped""")
def seeder_run(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "domains").withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen_at", "last_probed_at", "created_at", "updated_at")})
    due = domains.filter("id % 2 = 0").select(F.lit("host_probe").alias("kind"), F.lit("").alias("url"), "host", F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit(1).cast("long").alias("run_id"), F.col("id").alias("seq"))
    waiting = write_table(frontier.enqueue(crawl.empty_state(spark)["frontier"], frontier.items(due), F.lit(NOW)), "waiting")
    return jobs.run_seeder(domains, waiting, table(spark, d, "documents").select("host", F.col("doc_id").alias("ord")), "list", NOW)[2]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Well-known and robots answers of the domains: every third serves a catalog, every fifth an Agentmap, every seventh fails."""
    i, host = F.col("id"), F.col("host")
    doc = F.concat(F.lit('{"specVersion":"1.0","entries":[{"identifier":"urn:air:'), host, F.lit(':a","displayName":"A","type":"application/ai-skill","url":"https://'), host, F.lit('/a.md","representativeQueries":["p","q"]}]}'))
    doc = F.when(i % 2 == 0, doc).otherwise(F.replace(doc, F.lit('"specVersion":"1.0",'), F.lit("")))
    robots = F.when(i % 5 == 0, F.concat(F.lit("Agentmap: https://"), host, F.lit("/map.json\n"))).otherwise("User-agent: *\nDisallow:\n")
    well = F.struct(F.lit("/.well-known/ai-catalog.json").alias("path"), F.when(i % 7 == 0, 500).when(i % 3 == 0, 200).otherwise(404).alias("status"), F.lit("application/json").alias("content_type"), doc.alias("body"))
    rules = F.struct(F.lit("/robots.txt").alias("path"), F.lit(200).alias("status"), F.lit("text/plain").alias("content_type"), robots.alias("body"))
    mapped = F.struct(F.lit("/map.json").alias("path"), F.lit(200).alias("status"), F.lit("application/json").alias("content_type"), doc.alias("body"))
    skill = F.struct(F.lit("/a.md").alias("path"), F.when(i % 4 == 0, 200).otherwise(410).alias("status"), F.lit("text/markdown").alias("content_type"), F.lit("# a").alias("body"))
    rows = table(spark, d, "domains").select("host", F.explode(F.array(well, rules, mapped, skill)).alias("r"))
    url = F.concat(F.lit("https://"), host, F.col("r.path"))
    body = F.when(F.col("r.status") == 200, F.col("r.body").cast("binary"))
    return write_table(rows.select(url.alias("url"), url.alias("final_url"), "r.status", "r.content_type", body.alias("body"), F.lit(None).cast("string").alias("error_class")), "answers")


_METHODS_SQL = """SELECT id, host, 'well_known' AS method, CASE WHEN id % 7 = 0 THEN 'error' WHEN id % 3 = 0 THEN 'hit' ELSE 'miss' END AS outcome FROM domains UNION ALL SELECT id, host, 'robots_agentmap', CASE WHEN id % 5 = 0 THEN 'hit' ELSE 'miss' END FROM domains"""


@query(f"SELECT host, method, outcome, CASE WHEN outcome = 'error' THEN 'unreachable' WHEN outcome = 'miss' AND method = 'robots_agentmap' THEN 'no Agentmap directive' ELSE '' END AS detail FROM ({_METHODS_SQL})")
def direct_probes(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "domains").withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen_at", "last_probed_at", "created_at", "updated_at")})
    after, rows, _ = jobs.direct_probe(domains, domains.select("host"), _answers(spark, d), NOW)
    detail = F.when(F.col("outcome") == "error", "unreachable").otherwise(F.col("error_detail"))
    return rows.join(after.select(F.col("id").alias("domain_id"), "host"), "domain_id").select("host", "method", "outcome", detail.alias("detail"))


#: What a crawl of all domains comes to: hosts with a catalog at either place, catalogs, entries, artifacts.
_CRAWL_SQL = f"""WITH p AS ({_METHODS_SQL}), h AS (SELECT id, host, CASE WHEN method = 'well_known' THEN '/.well-known/ai-catalog.json' ELSE '/map.json' END AS path FROM p WHERE outcome = 'hit'), u AS (SELECT DISTINCT id, host FROM h)
SELECT 'domain' AS kind, host AS name, CASE WHEN id NOT IN (SELECT id FROM u) THEN 'not_found' WHEN id % 2 = 0 THEN 'found_valid' ELSE 'found_invalid' END AS outcome FROM domains
UNION ALL SELECT 'probe', host || ' ' || method, outcome FROM p
UNION ALL SELECT 'catalog', 'https://' || host || path, CASE WHEN id % 2 = 0 THEN 'valid' ELSE 'invalid' END FROM h
UNION ALL SELECT 'entry', 'https://' || host || path, 'urn:air:' || host || ':a' FROM h
UNION ALL SELECT 'artifact', 'https://' || host || '/a.md', CASE WHEN id % 4 = 0 THEN 'ok' ELSE 'error' END FROM u
UNION ALL SELECT 'item', 'host_probe', 'done' FROM domains
UNION ALL SELECT 'item', 'catalog_fetch', 'done' FROM h
UNION ALL SELECT 'item', 'artifact_fetch', 'done' FROM u"""


@query(_CRAWL_SQL)
def crawl_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of all domains to its end: host probes, catalogs found in both ways, their verdicts, entries and artifacts, closed items."""
    seeds_of = table(spark, d, "domains").select(F.col("host").alias("raw"), F.col("id").alias("ord"))
    state = crawl.crawl(crawl.start(spark, seeds_of, NOW), _answers(spark, d), NOW, crawl.Config())
    own = state["domains"].select(F.col("id").alias("domain_id"), "host")
    rows: list[tuple[str, DataFrame, Column, Column]] = [
        ("domain", state["domains"], F.col("host"), F.col("ard_status")),
        ("probe", state["probes"].join(own, "domain_id"), F.concat_ws(" ", "host", "method"), F.col("outcome")),
        ("catalog", state["catalogs"], F.col("source_url"), F.col("verification_status")),
        ("entry", state["entries"].join(state["catalogs"].select(F.col("id").alias("catalog_id"), "source_url"), "catalog_id"), F.col("source_url"), F.col("urn")),
        ("artifact", state["artifacts"].join(state["entries"].select(F.col("id").alias("entry_id")), "entry_id"), F.col("url"), F.col("fetch_status")),
        ("item", state["frontier"], F.col("kind"), F.col("status")),
    ]
    parts = [df.select(F.lit(kind).alias("kind"), name.alias("name"), outcome.alias("outcome")) for kind, df, name, outcome in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT " + " || ',' || ".join(f"'{c}'" for c in EXPORT_FIELDS) + " AS first_line, (SELECT count(*) FROM catalog_entries e JOIN ard_catalogs c ON e.catalog_id = c.id JOIN domains d ON c.domain_id = d.id) AS rows, true AS ordered")
def export_file(spark: SparkSession, d: str) -> DataFrame:
    """The CSV file as it is written and read again: its header, the rows that the summary counts, and whether lines are by entry."""
    joined = export.export_join(*(table(spark, d, n) for n in ("catalog_entries", "ard_catalogs", "domains")))
    path = f"{scratch_root(spark)}/tables/export-{uuid.uuid4().hex}"
    told = export.write_export(joined.withColumn("version", F.lpad(F.col("entry_id").cast("string"), 12, "0")), path, "csv")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    number = F.regexp_extract("value", r",(\d{12}),[a-z]*,", 1)
    found = lines.filter(number != "").groupBy("file").agg(F.min(number).alias("low"), F.max(number).alias("high")).collect()  # one row for each file
    spans = [(r.low, r.high) for r in sorted(found, key=lambda r: r.file)]
    header = spark.read.text(path).filter(F.col("value").startswith("host,")).first()
    return spark.createDataFrame([(header.value, told["rows"], all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)))], "first_line string, rows bigint, ordered boolean")

