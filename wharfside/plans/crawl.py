"""The crawl as super-steps over table snapshots.

``step`` is a function from one state, the responses known to it and a time
to the next state. Fetching is a join with the responses; whoever runs the
crawl online fetches the URLs that ``wanted_urls`` names between two steps.
Every table of a new state is written once, so a step never recomputes
the one before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfside.functions import hosts, links, urns
from wharfside.functions.jsontext import MISSING, json_text, member, read_json, scalar_text
from wharfside.functions.media import media_kind, parse_media
from wharfside.functions.slices import list_items, written_member
from wharfside.operators import frontier as fr
from wharfside.operators import store, verify
from wharfside.schemas import RESPONSES, empty_state
from wharfside.scratch import append_table, write_table
from wharfside.skew import numbered
from wharfside.sources.registry import harvest, whole_walks

State = dict[str, DataFrame]
WELL_KNOWN = "/.well-known/ai-catalog.json"


@dataclass
class Config:
    """Budgets; an explicit 0 is honoured."""

    max_depth: int = 2
    max_catalog_depth: int = 3
    max_referral_depth: int = 2
    max_pages_per_host: int = 200
    max_attempts: int = 3
    refresh_hours: int = 168
    harvest: bool = True
    fetch_artifacts: bool = True
    page_limit: int = 0
    agent: str = "wharfside"
    force: bool = False
    items_a_step: int = 100_000
    max_body: int = 5 << 20


_ITEM = "kind string, url string, host string, depth int, priority int, run_id bigint, parent_catalog_id bigint, registry_row_id bigint, artifact_entry_id bigint, seq struct<a:int,b:bigint,c:bigint>"


def _seq(kind: int, major: Column, minor: Column) -> Column:
    """Order of found items: by kind of finding, then by what they were found in, then by place."""
    return F.struct(F.lit(kind).alias("a"), major.cast("long").alias("b"), minor.cast("long").alias("c"))


def seed_items(seeds: DataFrame) -> DataFrame:
    """Items of seeds (raw, ord): a bare domain gives a host probe, a URL a page and a probe of its host."""
    url = F.col("raw").contains("://")
    kinds = F.when(url, F.array(F.lit("page_fetch"), F.lit("host_probe"))).otherwise(F.array(F.lit("host_probe")))
    rows = seeds.select("raw", "ord", url.alias("is_url"), F.posexplode(kinds).alias("pos", "kind"))
    host = F.when(F.col("kind") == "page_fetch", hosts.host_of(F.col("raw"))).when(F.col("is_url"), hosts.url_host(F.col("raw"))).otherwise(F.col("raw"))
    return _items(rows, F.col("kind"), F.when(F.col("kind") == "page_fetch", F.col("raw")).otherwise(F.lit("")), host, F.lit(0), _seq(0, F.col("ord"), F.col("pos")))


def _items(df: DataFrame, kind: Column, url: Column, host: Column, depth: Column, seq: Column, **more: Column) -> DataFrame:
    columns = {"kind": kind, "url": url, "host": host, "depth": depth, "priority": F.lit(0), "run_id": F.lit(1), "seq": seq} | more
    out = []
    for part in _ITEM.split(", "):
        name, kind_name = part.split(" ", 1)
        out.append(columns.get(name, F.lit(None)).cast(kind_name).alias(name))
    return df.select(*out).filter("coalesce(url, '') <> '' OR coalesce(host, '') <> ''")


def start(spark, seeds: DataFrame, now: datetime) -> State:  # noqa: ANN001
    """An empty state with the seeds in its frontier and the seed hosts among its domains."""
    state = empty_state(spark)
    items = seed_items(seeds)
    found = items.filter("kind = 'host_probe'").select("host", F.lit("seed").alias("discovery_source"), "seq")
    state["domains"] = write_table(store.upsert_domains(state["domains"], found, F.lit(now)), "domains")
    state["frontier"] = write_table(fr.enqueue(state["frontier"], fr.items(items), F.lit(now)), "frontier")
    return state


def wanted_urls(state: State, n: int) -> DataFrame:
    """URLs that the next n items need; a page or an artifact needs its host's robots.txt too."""
    ready = state["frontier"].filter("status = 'pending'").orderBy(F.col("priority").desc(), "id").limit(n)
    probe = F.array(F.concat(F.lit("https://"), F.col("host"), F.lit(WELL_KNOWN)), F.concat(F.lit("https://"), F.col("host"), F.lit("/robots.txt")))
    ruled = F.array(F.col("url"), F.concat(F.lit("https://"), hosts.host_of(F.col("url")), F.lit("/robots.txt")))
    urls = F.when(F.col("kind") == "host_probe", probe).when(F.col("kind").isin("page_fetch", "artifact_fetch"), ruled).otherwise(F.array("url"))
    return ready.select(F.explode(urls).alias("url")).filter("url IS NOT NULL").distinct()


def newest(responses: DataFrame) -> DataFrame:
    """The response of each URL that arrived last, and in ``n`` how many there are; ``responses`` has ``arrived``, which orders them.

    Of several that arrived together a successful one holds.
    """
    columns = [c.split(" ")[0] for c in RESPONSES.split(", ")]
    one = responses.withColumn("__ok", _http_ok()).withColumn("__h", F.xxhash64(*columns)).groupBy("url").agg(
        F.max_by(F.struct(*[c for c in columns if c != "url"]), F.struct("arrived", "__ok", "__h")).alias("r"), F.count(F.lit(1)).alias("n")
    )
    return one.select("url", "r.*", "n").select(*columns, "n")


def answerable(state: State, answers: DataFrame, now: datetime, cfg: Config, registry_pages: DataFrame | None = None) -> DataFrame:
    """(id): the pending items that a step can close with these ``answers`` (``newest``); all others would count as unanswered.

    A host probe needs the answers of both its URLs, unless its host was
    probed lately; a page or an artifact needs its host's robots.txt and, if
    that allows it, its own answer; a registry needs every page of its walk, unless it is
    beyond the referral depth. An item that has failed needs an answer for each attempt, so
    a failure is not counted again before the next answer has come.
    """
    pending = state["frontier"].filter("status = 'pending'")
    have = answers.select(F.col("url").alias("__u"), "n")
    fetches = pending.filter("kind <> 'host_probe' AND kind <> 'registry_harvest'").join(have, F.col("url") == F.col("__u"), "left")
    own = F.coalesce(F.col("n") > F.coalesce("attempts", F.lit(0)), F.lit(False))
    rules = answers.filter(F.col("url").endswith("/robots.txt")).groupBy(hosts.host_of(F.col("url")).alias("__rh")).agg(F.max(F.when(_http_ok(), F.col("body").cast("string"))).alias("robots"))
    ruled = fetches.filter("kind <> 'catalog_fetch'").withColumn("__h", hosts.host_of(F.col("url"))).join(rules, F.col("__h") == F.col("__rh"))
    allowed = F.coalesce(links.robots_allow_udf(F.coalesce("robots", F.lit("")), F.col("url"), F.lit(cfg.agent)), F.lit(True))
    out = [fetches.filter(F.col("kind") == "catalog_fetch").filter(own).select("id"), ruled.withColumn("__allowed", allowed).filter(own | ~F.col("__allowed")).select("id")]
    probes = pending.filter("kind = 'host_probe'").select("id", "host")
    there = probes
    for path in (WELL_KNOWN, "/robots.txt"):
        there = there.join(have, F.concat(F.lit("https://"), F.col("host"), F.lit(path)) == F.col("__u"), "left_semi")
    out.append(there.select("id"))
    if not cfg.force:
        known = state["domains"].filter(store.is_fresh(F.col("last_probed_at"), F.lit(now), cfg.refresh_hours))
        out.append(probes.join(known.select("host"), "host", "left_semi").select("id"))
    registries = pending.filter("kind = 'registry_harvest'").select("id", "depth", F.col("url").alias("base_url"))
    out.append(registries.filter(F.col("depth") > cfg.max_referral_depth).select("id"))
    near = registries.filter(F.col("depth") <= cfg.max_referral_depth)
    if registry_pages is not None and near.head(1):
        out.append(near.join(whole_walks(near, registry_pages, cfg.page_limit), "base_url", "left_semi").select("id"))
    return _union(out).distinct()


def drain(state: State, answers: DataFrame, clock: Callable[[], datetime], cfg: Config, registry_pages: DataFrame | None = None, keep: Callable[[State], None] | None = None) -> State:
    """Steps over the items that ``answers`` (``newest``, written) can close, until there is none; others stay pending. ``keep`` gets every new state."""
    responses = answers.drop("n")
    while cfg.items_a_step > 0:
        now = clock()
        ready = write_table(answerable(state, answers, now, cfg, registry_pages), "ready")
        if not ready.head(1):
            break
        state = step(state, responses, now, cfg, registry_pages, ready)
        if keep:
            keep(state)
    return state


_DOCS = (
    "key string, parent_key string, host string, source_url string, depth int, raw_json string, content_hash string, spec_version string, host_display_name string, host_identifier string, "
    "parent_catalog_id bigint, seq bigint, entries array<struct<idx:int,urn:string,display_name:string,media_type:string,ref_url:string,has_embedded_data:boolean,description:string,version:string,"
    "entry_updated_at:string,tags:string,capabilities:string,representative_queries:string,trust_manifest:string>>"
)


def _json_text(value: object) -> str:
    """JSON text of a list or object, '' when absent or empty (C11)."""
    if not value:
        return ""
    text = json_text(value)
    for sign in "<>&" + chr(0x2028) + chr(0x2029):
        text = text.replace(sign, f"\\u{ord(sign):04x}")
    return text


def entry_row(i: int, e: dict) -> dict:
    """A document's entry as a table row."""
    text = lambda n: scalar_text(member(e, n)) or ""
    return {
        "idx": i, "urn": text("identifier"), "display_name": text("displayName"), "media_type": text("type"), "ref_url": text("url"), "has_embedded_data": member(e, "data") is not None,
        "description": text("description"), "version": text("version"), "entry_updated_at": text("updatedAt"), "tags": _json_text(member(e, "tags")), "capabilities": _json_text(member(e, "capabilities")),
        "representative_queries": _json_text(member(e, "representativeQueries")), "trust_manifest": _json_text(member(e, "trustManifest")),
    }


def expand_document(raw: str, key: str, parent: str | None, source: str, depth: int, most: int) -> Iterator[dict]:
    """The row of a document and, depth-first, those of the catalogs embedded in it, each hashed over its written text."""
    doc = read_json(raw)
    row = {"key": key, "parent_key": parent, "source_url": source, "depth": depth, "raw_json": raw, "content_hash": hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()}
    whole = doc if doc is not MISSING and isinstance(doc, dict) else {}
    host = member(whole, "host")
    host = host if isinstance(host, dict) else {}
    listed = member(whole, "entries")
    entries = [(i, e) for i, e in enumerate(listed if isinstance(listed, list) else []) if isinstance(e, dict)]
    row |= {"spec_version": scalar_text(member(whole, "specVersion")) or "", "host_display_name": scalar_text(member(host, "displayName")) or "", "host_identifier": scalar_text(member(host, "identifier")) or ""}
    yield row | {"entries": [entry_row(i, e) for i, e in entries]}
    if depth >= most or not any(member(e, "data") is not None and not member(e, "url") for _, e in entries):
        return
    written = written_member(raw, "entries")
    assert written
    for i, (value, text) in enumerate(list_items(written[1])):
        kind = (scalar_text(member(value, "type")) or "").split(";")[0].split("+")[0].strip().lower() if isinstance(value, dict) else ""
        if kind == "application/ai-catalog" and not member(value, "url") and (data := written_member(text, "data")) and data[0] is not None:
            yield from expand_document(data[1], f"{key}/{i}", key, f"{source}#{scalar_text(member(value, 'identifier')) or ''}", depth + 1, most)


def _expander(most: int):  # noqa: ANN202
    columns = [c.split(" ")[0] for c in _DOCS.split(", ")[:13]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                body = bytes(r.body or b"").decode("utf-8", "replace")
                parent = None if pd.isna(r.parent_catalog_id) else int(r.parent_catalog_id)
                for row in expand_document(body, str(r.id), None, r.source_url, r.depth, most):
                    rows.append(row | {"host": r.host, "parent_catalog_id": parent if row["parent_key"] is None else None, "seq": r.id})
            out = pd.DataFrame(rows, columns=columns)
            out["parent_catalog_id"] = out["parent_catalog_id"].astype("Int64")
            yield out

    return run


def _http_ok(alias: str = "") -> Column:
    return F.coalesce((F.col(f"{alias}status") >= 200) & (F.col(f"{alias}status") < 400), F.lit(False))


def probe(probed: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, host, method, asked, http, content_type, outcome, detail, urls): both ways of asking each host of ``probed`` (id, host), in fixed order.

    The well-known address must answer with JSON, robots.txt with Agentmap
    lines; a 4xx answer is a miss, any other failure an error, and so is a
    host without an answer.
    """
    ways = F.array(F.struct(F.lit("well_known").alias("method"), F.lit(WELL_KNOWN).alias("path")), F.struct(F.lit("robots_agentmap").alias("method"), F.lit("/robots.txt").alias("path")))
    asked = probed.select("id", "host", F.explode(ways).alias("w")).select("id", "host", "w.method", F.concat(F.lit("https://"), F.col("host"), F.col("w.path")).alias("asked"))
    seen = asked.join(answers.withColumnRenamed("status", "http"), F.col("asked") == F.col("url"), "left").drop("url")
    text = F.col("body").cast("string")
    well, fine = F.col("method") == "well_known", F.col("o") == "ok"
    seen = seen.withColumns({
        "o": store.classify_fetch(F.col("http"), F.coalesce("error_class", F.when(F.col("http").isNull(), "unreachable"))),
        "is_json": hosts.looks_like_json(F.col("content_type"), text),
        "maps": links.agentmap_urls_udf(F.coalesce(text, F.lit("")), F.col("asked")),
    })
    nothing = F.array().cast("array<string>")
    urls = F.when(~fine | (well & ~F.col("is_json")), nothing).when(well, F.array(F.coalesce("final_url", "asked"))).otherwise(F.col("maps"))
    detail = (
        F.when(F.col("o") == "error", F.coalesce("error_class", F.lit("fetch failed")))
        .when(fine & well & ~F.col("is_json"), "non-JSON response")
        .when(fine & ~well & (F.size("maps") == 0), "no Agentmap directive")
        .otherwise("")
    )
    seen = seen.withColumn("urls", urls).withColumn("detail", detail)
    outcome = F.when(F.size("urls") > 0, "hit").when(F.col("o") == "error", "error").otherwise("miss")
    return seen.select("id", "host", "method", "asked", "http", "content_type", outcome.alias("outcome"), "detail", "urls")


def probe_rows(seen: DataFrame, domains: DataFrame, at: Column) -> DataFrame:
    """Rows of the probes table from ``probe``, for hosts that are domains."""
    own = seen.join(domains.select("host", F.col("id").alias("domain_id")), "host")
    return own.select("domain_id", "method", F.col("asked").alias("url"), F.col("http").alias("http_status"), "content_type", "outcome", F.col("detail").alias("error_detail"), at.alias("probed_at"))


def step(state: State, responses: DataFrame, now: datetime, cfg: Config, registry_pages: DataFrame | None = None, only: DataFrame | None = None) -> State:
    """One super-step: lease, handle every kind of item, store results, enqueue what was found, close the items.

    ``only`` (id) restricts what is leased; a leased item without a response counts as unanswered.
    """
    spark = responses.sparkSession
    at = F.lit(now)
    leased, after = fr.dequeue(state["frontier"], cfg.items_a_step, at, only=only)
    leased, after = write_table(leased, "leased"), write_table(after, "frontier")
    kinds = {r.kind for r in leased.select("kind").distinct().collect()}  # at most five; work that no item asks for is left out
    answers = responses.dropDuplicates(["url"])
    got = _fetched(leased, answers, cfg)
    found: list[DataFrame] = []
    hosts_found: list[DataFrame] = []
    probed_rows: list[DataFrame] = []
    statuses: list[DataFrame] = []
    page_items = None
    next_state = dict(state)
    order = _seq(0, F.col("id"), F.col("pos") + 2)

    # K1: pages
    if "page_fetch" in kinds:
        pages = got.filter("kind = 'page_fetch' AND allowed AND fetched AND lower(content_type) LIKE '%html%'")
        pages = write_table(pages.select("id", "depth", links.extract_links_udf(F.coalesce("final_url", "url"), F.col("body").cast("string")).alias("l")), "pages")
        page_hosts = pages.select("id", F.posexplode("l.hosts").alias("pos", "host"))
        hints = pages.select("id", F.posexplode("l.hints").alias("pos", "url")).withColumn("host", hosts.host_of(F.col("url")))
        more = pages.filter(F.col("depth") < cfg.max_depth).select("id", "depth", F.posexplode("l.links").alias("pos", "url")).withColumn("host", hosts.host_of(F.col("url")))
        found.append(_items(page_hosts, F.lit("host_probe"), F.lit(""), F.col("host"), F.lit(0), order))
        found.append(_items(hints, F.lit("catalog_fetch"), F.col("url"), F.col("host"), F.lit(0), order))
        page_items = _items(more, F.lit("page_fetch"), F.col("url"), F.col("host"), F.col("depth") + 1, order)
        hosts_found += [x.select("host", F.lit("anchor").alias("discovery_source"), order.alias("seq")) for x in (page_hosts, hints)]
        probed_rows.append(hints.select("host", F.lit("link_tag").alias("method"), F.col("url").alias("asked"), F.lit(None).cast("int").alias("http"), F.lit(None).cast("string").alias("content_type"), F.lit("hit").alias("outcome"), F.lit("").alias("detail")))

    # K2-K5: host probes
    if "host_probe" in kinds:
        probed = leased.filter("kind = 'host_probe'")
        if not cfg.force:
            known = state["domains"].filter(store.is_fresh(F.col("last_probed_at"), at, cfg.refresh_hours))
            probed = probed.join(known.select("host"), "host", "left_anti")
        seen = write_table(probe(probed, answers), "probes")
        hits = seen.select("id", "host", F.posexplode("urls").alias("pos", "url"))
        found.append(_items(hits, F.lit("catalog_fetch"), F.col("url"), F.col("host"), F.lit(0), order))
        hosts_found.append(probed.select("host", F.lit("seed").alias("discovery_source"), _seq(0, F.col("id"), F.lit(0)).alias("seq")))
        probed_rows.append(seen.select("host", "method", "asked", "http", "content_type", "outcome", "detail"))
        statuses.append(seen.groupBy("host").agg(F.max(F.col("outcome") == "hit").alias("hit")).filter("NOT hit").select("host", F.lit("not_found").alias("ard_status"), F.lit(0).cast("bigint").alias("seq")))

    # K6, K7, K9: catalogs with those embedded in them
    docs = None
    if "catalog_fetch" in kinds:
        docs_in = got.filter("kind = 'catalog_fetch' AND fetched").select("id", "host", F.coalesce("final_url", "url").alias("source_url"), "depth", "parent_catalog_id", "body")
        docs = write_table(docs_in.mapInPandas(_expander(cfg.max_catalog_depth), _DOCS), "documents")
        hosts_found.append(docs.select("host", F.lit("catalog_ref").alias("discovery_source"), _seq(0, F.col("seq"), F.lit(1)).alias("seq")))
    domains = write_table(store.upsert_domains(state["domains"], _union(hosts_found), at), "domains") if hosts_found else state["domains"]
    next_state["domains"] = domains
    listed = None
    if docs is not None and docs.head(1):
        linked, listed = _save_catalogs(state, next_state, docs, domains, at, cfg, found)
        statuses.append(linked.select("host", F.when(F.col("verification_status") == "invalid", "found_invalid").otherwise("found_valid").alias("ard_status"), F.col("id").alias("seq")))

    # registries
    work = leased.filter("kind = 'registry_harvest'").filter(F.col("depth") <= cfg.max_referral_depth)
    registries = state["registries"]
    if registry_pages is not None and "registry_harvest" in kinds and work.head(1):
        named, registries, next_state["entries"] = _harvest(spark, state, next_state, work, registry_pages, cfg)
        listed = named if listed is None else listed.unionByName(named)
        next_state["registries"] = registries
    if listed is not None:
        fresh = write_table(_number(listed.withColumn("id", F.lit(None).cast("bigint")), registries, ["entry_id", "base_url"]), "registries")
        next_state["registries"] = _append(registries, fresh, "registries")
        found.append(_items(fresh, F.lit("registry_harvest"), F.col("base_url"), F.col("host"), F.col("depth"), _seq(2, F.col("id"), F.lit(0)), registry_row_id=F.col("id")))

    # Artifacts, each of the entry whose pointer was followed
    if "artifact_fetch" in kinds:
        arts = got.filter("kind = 'artifact_fetch' AND allowed AND (fetched OR NOT transient)").select(
            F.col("artifact_entry_id").alias("entry_id"), F.coalesce("final_url", "url").alias("url"), F.coalesce("http", F.lit(0)).alias("http_status"), "content_type", F.when(F.col("fetched"), F.col("body")).alias("raw_body"),
            F.when(F.col("fetched"), F.sha2("body", 256)).alias("content_hash"), F.when(F.col("fetched"), "ok").otherwise("error").alias("fetch_status"), at.alias("fetched_at"),
        )
        next_state["artifacts"] = _append(state["artifacts"], arts, "artifacts")

    # Probes and statuses
    if probed_rows:
        rows = write_table(probe_rows(_union(probed_rows), domains, at), "probe_rows")
        next_state["probes"] = _append(state["probes"], rows, "probes")
        domains = store.record_probes(domains, rows)
    if statuses:
        domains = store.update_status(domains, _union(statuses))
    if probed_rows or statuses:
        next_state["domains"] = write_table(domains, "domains")

    # L2: close the items, then take in what was found
    bad = got.filter(~F.col("fetched") & F.col("allowed") & ~((F.col("kind") == "artifact_fetch") & ~F.col("transient")))
    errors = bad.select("id", F.coalesce("error_class", F.concat(F.lit("status "), F.coalesce("http", F.lit(0)).cast("string"))).alias("error"), (~F.col("transient")).alias("permanent"))
    after = fr.fail(after, errors, at, cfg.max_attempts)
    after = fr.complete(after, leased.select("id").join(errors.select("id"), "id", "left_anti"), at)
    after = write_table(after, "frontier")
    if found:
        after = write_table(fr.enqueue(after, fr.items(_union(found)), at), "frontier")
    if page_items is not None:
        after = write_table(fr.enqueue(after, fr.items(page_items), at, cfg.max_pages_per_host), "frontier")
    next_state["frontier"] = after
    return next_state


def _fetched(leased: DataFrame, answers: DataFrame, cfg: Config) -> DataFrame:
    """The leased items that need one answer, with it: allowed, fetched, transient."""
    robots = answers.filter(_http_ok()).filter(F.col("url").endswith("/robots.txt")).select(hosts.host_of(F.col("url")).alias("__rh"), F.col("body").cast("string").alias("robots"))
    got = leased.filter("kind <> 'host_probe' AND kind <> 'registry_harvest'").join(answers.withColumnRenamed("url", "__u").withColumnRenamed("status", "http"), F.col("url") == F.col("__u"), "left")
    # Rules are applied to addresses before bodies come in, so that the answers of a host with very many pages stay where they are.
    asked = leased.filter("kind IN ('page_fetch', 'artifact_fetch')").select("id", "url", hosts.host_of(F.col("url")).alias("__h")).join(robots, F.col("__h") == F.col("__rh"))
    refused = asked.filter(~F.coalesce(links.robots_allow_udf("robots", "url", F.lit(cfg.agent)), F.lit(True))).select("id", F.lit(False).alias("__may"))
    got = got.join(refused, "id", "left").withColumn("allowed", F.coalesce("__may", F.lit(True)))
    fetched = F.coalesce(F.col("http").between(200, 399), F.lit(False)) & (F.octet_length("body") <= cfg.max_body)
    return write_table(got.withColumn("fetched", fetched).withColumn("transient", store.is_transient(F.col("http"), F.col("error_class")) | F.col("__u").isNull()), "fetched")


def _save_catalogs(state: State, next_state: State, docs: DataFrame, domains: DataFrame, at: Column, cfg: Config, found: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Store new documents with their entries and checks, and add what their entries lead to (K7, K8, K10): the catalogs, and the registries they name."""
    docs = docs.join(domains.select("host", F.col("id").alias("domain_id")), "host")
    if not cfg.force:
        last = fr.latest(state["catalogs"].select("domain_id", "source_url", "id", "content_hash", "fetched_at"), ["domain_id", "source_url"], ["fetched_at", "id"])
        docs = docs.join(last.select("domain_id", "source_url", "content_hash"), ["domain_id", "source_url", "content_hash"], "left_anti")
    new = write_table(_number(docs, state["catalogs"], ["seq", "key"]), "new")
    verified = write_table(verify.verify_documents(new, domain=F.col("host")), "verified")
    parents = new.select(F.col("key").alias("__k"), F.col("seq").alias("__s"), F.col("id").alias("__p"))
    linked = new.join(parents, (F.col("parent_key") == F.col("__k")) & (F.col("seq") == F.col("__s")), "left").withColumn("parent_catalog_id", F.coalesce("__p", "parent_catalog_id"))
    linked = linked.join(verified.select(F.col("catalog_id").alias("id"), F.col("verdict").alias("verification_status")), "id").withColumn("fetched_at", at)
    next_state["catalogs"] = _append(state["catalogs"], linked, "catalogs")
    e = new.select(F.col("id").alias("catalog_id"), "seq", "host", "depth", F.explode("entries").alias("e")).select("catalog_id", "host", "depth", "e.*")
    u = urns.parse_urn(urns.with_ascii_publisher(F.col("urn")))
    e = e.withColumn("u", u).withColumns({"urn_publisher": F.col("u.publisher"), "urn_namespace": F.col("u.namespace"), "urn_name": F.col("u.name"), "source": F.lit("catalog")}).withColumn("id", F.lit(None).cast("bigint"))
    entries = write_table(_number(e, state["entries"], ["catalog_id", "idx"]), "entries")
    next_state["entries"] = _append(state["entries"], entries, "entries")
    rows = verify.split_subjects(verify.check_rows(verified), entries.select("id", "catalog_id", "urn"))
    next_state["checks"] = _append(state["checks"], rows, "checks")
    todo = entries.join(new.filter(F.col("depth") < cfg.max_catalog_depth).select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi")
    follow = store.followups(todo, cfg.harvest, cfg.fetch_artifacts).join(entries.select(F.col("id").alias("entry_id"), "host", "depth"), "entry_id")
    follow = write_table(follow, "followups")
    late = _seq(1, F.col("entry_id"), F.lit(0))
    found.append(_items(follow.filter("follow = 'catalog_fetch'"), F.lit("catalog_fetch"), F.col("url"), F.col("host"), F.col("depth") + 1, late, parent_catalog_id=F.col("catalog_id")))
    found.append(_items(follow.filter("follow = 'artifact_fetch'"), F.lit("artifact_fetch"), F.col("url"), F.col("host"), F.lit(0), late, artifact_entry_id=F.col("entry_id")))
    listed = follow.filter("follow = 'registry_harvest'").select("entry_id", "catalog_id", F.col("url").alias("base_url"), F.lit("pending").alias("harvest_status"), F.lit(None).cast("bigint").alias("referral_source_id"), "host", F.lit(0).alias("depth"))
    return linked.select("host", "verification_status", "id"), listed


def _harvest(spark, state: State, next_state: State, work: DataFrame, pages: DataFrame, cfg: Config):  # noqa: ANN001, ANN202
    """Walk the pages of the leased registries: statuses, registry entries, and the registries they and the referrals name."""
    walked = write_table(harvest(work.select(F.col("url").alias("base_url")), pages, cfg.page_limit), "walked")
    ok = walked.groupBy("base_url").agg(F.min(F.when(F.col("status") == 200, 1).otherwise(0)).alias("ok"), F.max(F.when(F.col("status") == 501, 1).otherwise(0)).alias("never"))
    rows = work.select(F.col("registry_row_id").alias("id"), F.col("url").alias("base_url"), "host", "depth").filter("id IS NOT NULL")
    status = rows.join(ok, "base_url").select("id", F.when(F.col("ok") == 1, "ok").when(F.col("never") == 1, "error").alias("__s"))
    registries = write_table(state["registries"].join(status, "id", "left").withColumn("harvest_status", F.coalesce("__s", "harvest_status")).select(*state["registries"].columns), "registries")
    own = rows.join(ok.filter("ok = 1"), "base_url").join(registries.select("id", "entry_id", "catalog_id"), "id")
    hits = walked.join(own, "base_url").select(F.col("id").alias("source_registry_id"), "catalog_id", "host", "depth", "page_no", F.posexplode("results").alias("idx", "r")).select("*", "r.*").drop("r")
    u = urns.parse_urn(urns.with_ascii_publisher(F.coalesce("urn", F.lit(""))))
    hits = hits.withColumn("u", u).withColumns({"urn_publisher": F.col("u.publisher"), "urn_namespace": F.col("u.namespace"), "urn_name": F.col("u.name"), "source": F.lit("registry"), "has_embedded_data": F.lit(False)})
    fresh = write_table(_number(hits.withColumn("id", F.lit(None).cast("bigint")), next_state["entries"], ["source_registry_id", "page_no", "idx"]), "registry_entries")
    entries = _append(next_state["entries"], fresh, "entries")
    kind = media_kind(parse_media(F.col("media_type")))
    named = fresh.filter((kind == "registry") & (F.coalesce(F.col("ref_url"), F.lit("")) != "") & F.lit(cfg.harvest))
    named = named.select(F.col("id").alias("entry_id"), "catalog_id", F.col("ref_url").alias("base_url"), F.lit("pending").alias("harvest_status"), F.col("source_registry_id").alias("referral_source_id"), "host", (F.col("depth") + 1).alias("depth"))
    ref = walked.join(own, "base_url").filter(F.col("depth") + 1 <= cfg.max_referral_depth).select("entry_id", "catalog_id", F.col("id").alias("referral_source_id"), "host", (F.col("depth") + 1).alias("depth"), F.explode("referrals").alias("x"))
    ref = ref.filter("x.ref_url <> ''").select("entry_id", "catalog_id", F.col("x.ref_url").alias("base_url"), F.lit("pending").alias("harvest_status"), "referral_source_id", "host", "depth")
    return named.unionByName(ref), registries, entries


def _number(rows: DataFrame, present: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ids after the highest present one."""
    top = present.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(rows, order, "__rank", "numbers").withColumn("id", F.col("__rank") + F.lit(top)).drop("__rank")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _append(present: DataFrame, fresh: DataFrame, name: str) -> DataFrame:
    """Present rows and the fresh ones in the table's columns; absent columns are null."""
    columns = [(F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in present.schema.fields]
    return append_table(present, fresh.select(*columns), name)


class Unfinished(RuntimeError):
    """A crawl that ended before its frontier was empty; ``state`` is the last one and can be crawled on."""

    def __init__(self, why: str, state: State, pending: int, in_flight: int) -> None:
        super().__init__(f"{why}: {pending} items pending, {in_flight} in flight")
        self.state, self.pending, self.in_flight = state, pending, in_flight


def crawl(state: State, responses: DataFrame, now: datetime, cfg: Config, registry_pages: DataFrame | None = None, most_steps: int | None = None) -> State:
    """Steps until nothing is pending or in flight (L2).

    Leases that are over by ``now`` are taken back first. ``Unfinished`` is
    raised when items are left after ``most_steps``, or when no step can take
    them: others hold them, or ``items_a_step`` is 0.
    """
    state = state | {"frontier": write_table(fr.reclaim(state["frontier"], F.lit(now)), "frontier")}
    steps = 0
    while True:
        left = fr.counts(state["frontier"]).first()
        if left.pending + left.in_flight == 0:
            return state
        if most_steps is not None and steps >= most_steps:
            raise Unfinished(f"{steps} steps weren't enough", state, left.pending, left.in_flight)
        if left.pending == 0 or cfg.items_a_step <= 0:
            raise Unfinished("no item can be leased", state, left.pending, left.in_flight)
        state = step(state, responses, now, cfg, registry_pages)
        steps += 1
