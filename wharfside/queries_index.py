"""Registered queries of the index operators, each over whole tables, with the SQL to check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside.functions import exporttext, hosts, links, media, urns
from wharfside.operators import export, frontier, reports, store, verify
from wharfside.sources import seeds
from wharfside.tables import EXPORT_FIELDS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "TIMESTAMP '2026-03-01 00:00:00'"


def query(sql: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _now() -> Column:
    return F.to_timestamp(F.lit("2026-03-01 00:00:00"))


# --- export and reports -----------------------------------------------------------------------

_BLANKS = ", ".join(f"coalesce(e.{c}, '') AS {c}" for c in ("urn", "urn_publisher", "display_name", "media_type", "ref_url", "description", "version", "source", "tags", "representative_queries"))
_EXPORT_SQL = f"""SELECT e.id AS entry_id, d.host, c.source_url AS catalog_source_url, c.verification_status, {_BLANKS}
FROM catalog_entries e JOIN ard_catalogs c ON e.catalog_id = c.id JOIN domains d ON c.domain_id = d.id"""


@query(_EXPORT_SQL)
def export_join(spark: SparkSession, d: str) -> DataFrame:
    return export.export_join(*(table(spark, d, n) for n in ("catalog_entries", "ard_catalogs", "domains")))


def _sql_json(c: str) -> str:
    out = f"replace({c}, chr(92), chr(92) || chr(92))"
    for sign, code in (("chr(34)", 'chr(92) || chr(34)'), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"), ("'<'", "chr(92) || 'u003c'"), ("'>'", "chr(92) || 'u003e'"), ("'&'", "chr(92) || 'u0026'")):
        out = f"replace({out}, {sign}, {code})"
    return f"chr(34) || {out} || chr(34)"


_JSONL_SQL = "SELECT entry_id, '{' || " + " || ',' || ".join(f"'\"{c}\":' || {_sql_json(c)}" for c in EXPORT_FIELDS) + f" || '}}' AS value FROM ({_EXPORT_SQL})"


@query(_JSONL_SQL)
def export_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return export_join(spark, d).select("entry_id", exporttext.json_line(EXPORT_FIELDS).alias("value"))


def _sql_csv(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') OR regexp_matches({c}, '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') THEN chr(34) || replace({c}, chr(34), chr(34) || chr(34)) || chr(34) ELSE {c} END"


@query("SELECT entry_id, " + " || ',' || ".join(_sql_csv(c) for c in EXPORT_FIELDS) + f" AS value FROM ({_EXPORT_SQL})")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return export_join(spark, d).select("entry_id", exporttext.csv_line(EXPORT_FIELDS).alias("value"))


@query("SELECT CASE WHEN media_type IS NULL OR media_type = '' THEN '(empty)' ELSE media_type END AS label, n FROM (SELECT media_type, count(*) AS n FROM catalog_entries GROUP BY media_type)")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return export.group_count(table(spark, d, "catalog_entries"), "media_type")


_STATS = " UNION ALL ".join(
    f"SELECT '{s}' AS section, CASE WHEN {c} IS NULL OR {c} = '' THEN '(empty)' ELSE {c} END AS label, count(*) AS n FROM {t} GROUP BY {c} UNION ALL SELECT '{s}', '(total)', count(*) FROM {t}"
    for s, t, c in (("domains", "domains", "ard_status"), ("catalogs", "ard_catalogs", "verification_status"), ("entries", "catalog_entries", "media_type"))
)


@query(_STATS)
def stats_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.stats(*(table(spark, d, n) for n in ("domains", "ard_catalogs", "catalog_entries")))


@query("SELECT content_hash, count(*) AS n FROM ard_catalogs GROUP BY content_hash HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return reports.duplicate_groups(table(spark, d, "ard_catalogs"), ["content_hash"])


@query("SELECT domain_id, source_url, id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, source_url ORDER BY fetched_at DESC, id DESC) AS rn FROM ard_catalogs) WHERE rn = 1")
def latest_catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ard_catalogs").select("domain_id", "source_url", "id", "content_hash", "fetched_at")
    return frontier.latest(rows, ["domain_id", "source_url"], ["fetched_at", "id"]).drop("fetched_at")


@query(f"SELECT id, host, coalesce(last_probed_at > {NOW} - INTERVAL 168 HOUR, false) AS fresh FROM domains")
def fresh_domains(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "domains")
    return domains.select("id", "host", store.is_fresh(F.col("last_probed_at").cast("timestamp"), _now()).alias("fresh"))


@query("SELECT id AS entry_id, unnest(CAST(tags AS JSON)::VARCHAR[]) AS tag FROM catalog_entries WHERE json_valid(tags) AND json_type(tags) = 'ARRAY'")
def entry_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "catalog_entries").select(F.col("id").alias("entry_id"), F.explode(F.from_json("tags", "array<string>")).alias("tag"))
    return rows


# --- scalar functions ---------------------------------------------------------------------------

@query("SELECT doc_id, sha256('page_fetch:' || url) AS dedup_key FROM documents")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hosts.dedup_key(F.lit("page_fetch"), F.col("url")).alias("dedup_key"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(host, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query(f"SELECT id, CAST({_FNV} % 8192 AS INTEGER) AS shard FROM domains")
def host_shards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domains").select("id", hosts.host_shard(F.col("host")).alias("shard"))


@query("SELECT doc_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host_port FROM documents")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hosts.url_host(F.col("url")).alias("host"), hosts.host_of(F.col("url")).alias("host_port"))


_MESSY = "CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN ' *.' || upper(host) || '. ' WHEN 1 THEN host || ':8080' WHEN 2 THEN '10.0.0.' || (id % 256) WHEN 3 THEN split_part(host, '.', 1) WHEN 4 THEN replace(host, '.', '-.') ELSE host END"


@query(
    f"""WITH r AS (SELECT id, regexp_replace(regexp_replace(lower(trim({_MESSY})), '^\\*\\.', ''), '\\.$', '') AS n FROM domains)
SELECT id, CASE WHEN n LIKE '%.%' AND NOT regexp_matches(n, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') AND regexp_matches(n, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$') THEN n END AS host FROM r"""
)
def sanitized_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domains").select("id", hosts.sanitize_host(F.expr(_MESSY)).alias("host"))


@query("SELECT id, array_to_string(list_reverse(string_split(host, '.')), '.') AS reversed, array_to_string(string_split(host, '.')[-2:], '.') AS registrable FROM domains")
def host_labels(spark: SparkSession, d: str) -> DataFrame:
    host = F.col("host")
    return table(spark, d, "domains").select("id", hosts.reverse_host(host).alias("reversed"), hosts.registrable_domain(host).alias("registrable"))


_INFRA = ", ".join(f"'{x}'" for x in hosts.INFRA_DOMAINS)


@query(
    f"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>"'')\\]]+')) AS url FROM documents), h AS (SELECT doc_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM u)
SELECT host, count(*) AS n, count(DISTINCT doc_id) AS pages FROM h WHERE host <> '' AND array_to_string(string_split(host, '.')[-2:], '.') NOT IN ({_INFRA}) GROUP BY host"""
)
def text_hosts(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(hosts.hosts_of_text(F.col("text"))).alias("host"))
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("pages"))


_KIND = "CASE " + " ".join(f"WHEN t || '/' || b = '{k}' THEN '{v}'" for k, v in media.KINDS.items()) + " ELSE 'unknown' END"


@query(
    f"""WITH m AS (SELECT id, lower(trim(split_part(coalesce(media_type, ''), ';', 1))) AS f FROM catalog_entries),
p AS (SELECT id, CASE WHEN f LIKE '%/%' THEN split_part(f, '/', 1) ELSE '' END AS t, CASE WHEN f LIKE '%/%' THEN regexp_replace(f, '^[^/]*/', '') ELSE f END AS r FROM m),
q AS (SELECT id, t, CASE WHEN r LIKE '%+%' THEN regexp_replace(r, '\\+[^+]*$', '') ELSE r END AS b, CASE WHEN r LIKE '%+%' THEN regexp_extract(r, '\\+([^+]*)$', 1) ELSE '' END AS s FROM p)
SELECT id, t || '/' || b AS full_type, s AS suffix, {_KIND} AS kind,
CASE WHEN s = 'json' THEN 'json' WHEN s = 'md' THEN 'markdown' WHEN s = 'zip' THEN 'zip' WHEN s = 'gzip' THEN 'gzip' WHEN t = 'text' AND b = 'markdown' THEN 'markdown' WHEN t = 'text' AND b = 'html' THEN 'html' WHEN t = 'text' AND b = 'plain' THEN 'text' ELSE 'unknown' END AS format FROM q"""
)
def media_types(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "catalog_entries").select("id", media.parse_media(F.col("media_type")).alias("m"))
    m = F.col("m")
    return parsed.select("id", media.full_type(m).alias("full_type"), m["suffix"].alias("suffix"), media.media_kind(m).alias("kind"), media.media_format(m).alias("format"))


@query("SELECT id, coalesce(urn_publisher, '') AS publisher, coalesce(urn_namespace, '') AS namespace, coalesce(urn_name, '') AS name FROM catalog_entries")
def urn_parts(spark: SparkSession, d: str) -> DataFrame:
    u = urns.parse_urn(F.coalesce("urn", F.lit("")))
    return table(spark, d, "catalog_entries").select("id", u.alias("u")).select("id", "u.publisher", "u.namespace", "u.name")


@query("SELECT id, regexp_matches(coalesce(raw_json, ''), '^[ \\t\\r\\n]*[\\[{]') AS json_body, CAST(strlen(raw_json) AS INTEGER) AS size FROM ard_catalogs")
def body_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ard_catalogs").select("id", hosts.looks_like_json(F.lit("text/plain"), F.col("raw_json")).alias("json_body"), F.octet_length("raw_json").alias("size"))


# --- verification -------------------------------------------------------------------------------

def _verified(spark: SparkSession, d: str) -> DataFrame:
    catalogs = table(spark, d, "ard_catalogs")
    return verify.verify_documents(catalogs, domain=hosts.url_host(F.col("source_url")))


@query()
def verify_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select("catalog_id", "verdict", F.size("checks").alias("checks"))


@query()
def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    return verify.check_rows(_verified(spark, d))


@query()
def failing_summary(spark: SparkSession, d: str) -> DataFrame:
    return verify.failing_summary(_verified(spark, d))


_KIND_E = "CASE WHEN lower(media_type) LIKE 'application/ai-catalog%' THEN 'catalog' WHEN lower(media_type) LIKE 'application/ai-registry%' THEN 'registry' ELSE 'other' END"


@query(
    f"""WITH k AS (SELECT *, {_KIND_E} AS kind FROM catalog_entries), f AS (SELECT id AS entry_id, catalog_id, coalesce(ref_url, '') AS url,
CASE WHEN kind = 'catalog' AND ref_url <> '' THEN 'catalog_fetch' WHEN kind = 'catalog' AND has_embedded_data THEN 'embedded_catalog' WHEN kind = 'catalog' THEN NULL WHEN kind = 'registry' AND ref_url <> '' THEN 'registry_harvest' WHEN ref_url <> '' THEN 'artifact_fetch' END AS follow FROM k)
SELECT * FROM f WHERE follow IS NOT NULL"""
)
def entry_followups(spark: SparkSession, d: str) -> DataFrame:
    return store.followups(table(spark, d, "catalog_entries"))


# --- frontier -----------------------------------------------------------------------------------

_FRONTIER_SQL = f"""SELECT doc_id AS id, 1 AS run_id, 'page_fetch' AS kind, url, host, 0 AS depth, CAST(n_chars % 5 AS INTEGER) AS priority,
CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'pending' WHEN 1 THEN 'in_flight' WHEN 2 THEN 'done' ELSE 'failed' END AS status, CAST(doc_id % 3 AS INTEGER) AS attempts, 'e' AS last_error,
CASE WHEN doc_id % 4 = 1 THEN fetched_at END AS leased_until FROM documents"""


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    i = F.col("doc_id")
    status = F.when(i % 4 == 0, "pending").when(i % 4 == 1, "in_flight").when(i % 4 == 2, "done").otherwise("failed")
    rows = docs.select(
        i.alias("id"), F.lit(1).cast("long").alias("run_id"), F.lit("page_fetch").alias("kind"), "url", "host", F.lit(0).alias("depth"), (F.col("n_chars") % 5).cast("int").alias("priority"),
        status.alias("status"), (i % 3).cast("int").alias("attempts"), F.lit("e").alias("last_error"), F.when(i % 4 == 1, F.col("fetched_at")).alias("leased_until"), F.lit("w").alias("worker_id"),
        F.col("fetched_at").alias("updated_at"),
    )
    return frontier.items(rows)


@query(f"SELECT id, url, priority FROM ({_FRONTIER_SQL}) WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 100")
def dequeue_topk(spark: SparkSession, d: str) -> DataFrame:
    return frontier.dequeue(_frontier(spark, d), 100, _now())[0].select("id", "url", "priority")


@query(f"SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'in_flight') AS in_flight FROM ({_FRONTIER_SQL})")
def frontier_counts(spark: SparkSession, d: str) -> DataFrame:
    return frontier.counts(_frontier(spark, d))


@query(f"SELECT host, kind, count(*) AS n FROM ({_FRONTIER_SQL}) GROUP BY host, kind")
def host_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return frontier.by_host_and_kind(_frontier(spark, d))


@query(f"SELECT id, CASE WHEN status = 'in_flight' AND leased_until < TIMESTAMP '2026-02-01 00:00:00' THEN 'pending' ELSE status END AS status FROM ({_FRONTIER_SQL})")
def reclaim_expired(spark: SparkSession, d: str) -> DataFrame:
    return frontier.reclaim(_frontier(spark, d), F.to_timestamp(F.lit("2026-02-01 00:00:00"))).select("id", "status")


@query(f"SELECT id, CASE WHEN status <> 'in_flight' THEN status WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN status = 'in_flight' THEN attempts + 1 ELSE attempts END AS attempts FROM ({_FRONTIER_SQL})")
def fail_items(spark: SparkSession, d: str) -> DataFrame:
    items = _frontier(spark, d)
    errors = items.select("id", F.lit("timeout").alias("error"), F.lit(False).alias("permanent"))
    return frontier.fail(items, errors, _now()).select("id", "status", "attempts")


_INCOMING_SQL = "SELECT source_url AS url, regexp_extract(source_url, '://([^/]+)', 1) AS host, min(id) AS seq FROM ard_catalogs GROUP BY source_url UNION ALL SELECT url, host, doc_id + 1000000000 FROM documents"


@query(
    f"""WITH f AS ({_FRONTIER_SQL}), i AS ({_INCOMING_SQL}), n AS (SELECT i.* FROM i WHERE url NOT IN (SELECT url FROM f)),
r AS (SELECT n.*, row_number() OVER (PARTITION BY n.host ORDER BY n.seq) AS rk, coalesce(u.c, 0) AS c FROM n LEFT JOIN (SELECT host, count(*) AS c FROM f GROUP BY host) u ON n.host = u.host)
SELECT url, host, CASE WHEN status IN ('done', 'failed') THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('done', 'failed') THEN 0 ELSE attempts END AS attempts FROM f
UNION ALL SELECT url, host, 'pending', 0 FROM r WHERE rk + c <= 40"""
)
def enqueue_merge(spark: SparkSession, d: str) -> DataFrame:
    catalogs = table(spark, d, "ard_catalogs").groupBy(F.col("source_url").alias("url")).agg(F.min("id").alias("seq")).withColumn("host", hosts.host_of(F.col("url")))
    pages = table(spark, d, "documents").select("url", (F.col("doc_id") + 1_000_000_000).alias("seq"), "host")
    found = catalogs.unionByName(pages).select(F.lit("page_fetch").alias("kind"), "url", "host", F.lit(1).alias("depth"), F.lit(0).alias("priority"), F.lit(2).cast("long").alias("run_id"), "seq")
    merged = frontier.enqueue(_frontier(spark, d), frontier.items(found), _now(), budget=40)
    return merged.select("url", "host", "status", "attempts")


@query("SELECT host, discovery_source FROM (SELECT host, source AS discovery_source, row_number() OVER (PARTITION BY host ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn = 1")
def first_source(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "domains").limit(0)
    found = table(spark, d, "documents").filter("source IS NOT NULL").select("host", F.col("source").alias("discovery_source"), F.col("doc_id").alias("seq"))
    return store.upsert_domains(domains, found, _now()).select("host", "discovery_source")


_FOUND_HOSTS_SQL = """SELECT regexp_extract(source_url, '://([^/?#]+)', 1) AS host, 'catalog_ref' AS source, id AS seq FROM ard_catalogs
UNION ALL SELECT host, coalesce(source, 'anchor'), doc_id + 1000000000 FROM documents
UNION ALL SELECT regexp_replace(host, '^[^.]+[.]', ''), 'parent', doc_id + 2000000000 FROM documents"""


@query(
    f"""WITH f AS ({_FOUND_HOSTS_SQL}), n AS (SELECT host, arg_min(source, seq) AS source, min(seq) AS seq FROM f WHERE host IS NOT NULL AND host NOT IN (SELECT host FROM domains) GROUP BY host)
SELECT id, host, first_seen_at, last_probed_at, discovery_source, ard_status, created_at, updated_at FROM domains
UNION ALL SELECT (SELECT max(id) FROM domains) + row_number() OVER (ORDER BY seq, host), host, {NOW}, NULL, source, 'unprobed', {NOW}, {NOW} FROM n"""
)
def domains_merge(spark: SparkSession, d: str) -> DataFrame:
    catalogs = table(spark, d, "ard_catalogs").select(hosts.host_of(F.col("source_url")).alias("host"), F.lit("catalog_ref").alias("discovery_source"), F.col("id").alias("seq"))
    pages = table(spark, d, "documents").select("host", F.coalesce("source", F.lit("anchor")).alias("discovery_source"), (F.col("doc_id") + 1_000_000_000).alias("seq"))
    # Every catalog and page host is a domain already; the names above the page hosts are new ones.
    parents = table(spark, d, "documents").select(F.regexp_replace("host", "^[^.]+[.]", "").alias("host"), F.lit("parent").alias("discovery_source"), (F.col("doc_id") + 2_000_000_000).alias("seq"))
    return store.upsert_domains(table(spark, d, "domains"), catalogs.unionByName(pages).unionByName(parents), _now())


@query(f"""SELECT (SELECT count(*) FILTER (WHERE status = 'done' AND fetched_at >= TIMESTAMP '2026-01-15') FROM (SELECT f.*, d.fetched_at FROM ({_FRONTIER_SQL}) f JOIN documents d ON f.id = d.doc_id)) AS pages_fetched,
(SELECT count(DISTINCT id) FROM domains WHERE last_probed_at >= TIMESTAMP '2026-01-15') AS hosts_probed,
(SELECT count(*) FROM ard_catalogs WHERE fetched_at >= TIMESTAMP '2026-01-15') AS catalogs_found,
(SELECT count(*) FROM ard_catalogs WHERE fetched_at >= TIMESTAMP '2026-01-15' AND verification_status IN ('valid', 'valid_with_warnings')) AS catalogs_valid,
(SELECT count(*) FILTER (WHERE status = 'failed' AND fetched_at >= TIMESTAMP '2026-01-15') FROM (SELECT f.*, d.fetched_at FROM ({_FRONTIER_SQL}) f JOIN documents d ON f.id = d.doc_id)) AS errors""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "domains").select(F.col("id").alias("domain_id"), F.col("last_probed_at").cast("timestamp").alias("probed_at"))
    catalogs = table(spark, d, "ard_catalogs").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return reports.run_summary(_frontier(spark, d), probes, catalogs, F.to_timestamp(F.lit("2026-01-15 00:00:00")))


# --- links and seed sources ---------------------------------------------------------------------


@query("SELECT doc_id, split_part(url, '#', 1) AS link, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM documents")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><a href='mailto:x'>m</a><A HREF=\""), F.col("url"), F.lit("\">p</A><a href='"), F.substring_index("url", "#", 1), F.lit("#top'>again</a>"))
    rows = table(spark, d, "documents").select("doc_id", links.extract_links_udf(F.lit("https://base.example/"), page).alias("l"))
    return rows.select("doc_id", F.explode("l.links").alias("link"), F.element_at("l.hosts", 1).alias("host"))


@query("SELECT host, CAST(rk AS BIGINT) AS ord FROM (SELECT host, row_number() OVER (ORDER BY id) AS rk FROM domains) WHERE rk > 10 ORDER BY rk LIMIT 50")
def ranked_seeds(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("id").cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), hosts.reverse_host(F.col("host")), F.lit("9"))
    return seeds.ranked_hosts(table(spark, d, "domains").select(F.col("id").alias("ord"), line.alias("line")), 50, offset=10)


@query("SELECT host, min(doc_id) AS ord FROM documents WHERE host IS NOT NULL GROUP BY host")
def first_seen_hosts(spark: SparkSession, d: str) -> DataFrame:
    return seeds.first_seen(table(spark, d, "documents").select(F.concat(F.lit("*."), F.upper("host"), F.lit(".")).alias("raw"), F.col("doc_id").alias("ord")))
