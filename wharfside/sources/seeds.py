"""Seed sources as DataFrames of (host, ord): fetched payloads in, ordered clean hosts out.

Every source takes already fetched payloads (text, JSON, rows) as a DataFrame;
``ord`` carries the order of the source, which is part of the result: a number, or a struct of numbers where
places nest (document, place in it).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside.functions import hosts
from wharfside.skew import numbered

#: Records of one certificate search that are read at most, and its default keywords. Fixed values.
CRTSH_RECORDS = 100_000
CRTSH_KEYWORDS = ["agent", "mcp", "ai-catalog"]
#: Days ahead within which a future log shard counts. Fixed value.
FRESH_DAYS = 400


def first_seen(raw: DataFrame, n: int | None = None) -> DataFrame:
    """(host, ord) of the first n distinct clean hosts of (raw, ord) in order; all of them without n."""
    clean = raw.select(hosts.sanitize_host(F.col("raw")).alias("host"), "ord").filter("host IS NOT NULL")
    one = clean.groupBy("host").agg(F.min("ord").alias("ord"))
    return one.orderBy("ord", "host").limit(n) if n is not None else one


def listed_seeds(spark: SparkSession, lists: DataFrame, positional: list[str]) -> DataFrame:
    """(raw, ord): positional seeds, then the lines of list texts (path, text) by path and line, trimmed, without blank and # lines (A3)."""
    given = spark.createDataFrame([(s, i) for i, s in enumerate(positional)], "raw string, ord bigint")
    lines = lists.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.trim("raw")).filter("raw <> '' AND NOT startswith(raw, '#')")
    ranked = numbered(lines, ["path", "line"], "ord", "lines")
    return given.unionByName(ranked.select("raw", (F.col("ord") + len(positional) - 1).alias("ord")))


def ct_names(leaves: DataFrame, logs: list[str], n: int) -> DataFrame:
    """(host, ord) from certificate log leaves (log, index, names, parsed): the last entries of each log in turn.

    A log is read over its last r entries, where r is n less the raw names that earlier logs gave; unreadable leaves are skipped.
    """
    order = F.create_map(*[F.lit(x) for i, u in enumerate(logs) for x in (u, i)]) if logs else F.create_map().cast("map<string,int>")
    mine = leaves.withColumn("__log", F.element_at(order, F.col("log"))).filter("__log IS NOT NULL")
    size = {r["__log"]: r.n for r in mine.groupBy("__log").agg((F.max("index") + 1).alias("n")).collect()}  # one row for each log
    taken, parts = 0, []
    for i in sorted(size):
        if (left := n - taken) <= 0:
            break
        part = mine.filter((F.col("__log") == i) & (F.col("index") >= max(0, size[i] - left)) & F.col("parsed"))
        taken += part.agg(F.sum(F.size("names"))).first()[0] or 0
        parts.append(part.select("__log", "index", F.posexplode("names").alias("pos", "raw")))
    if not parts:
        return leaves.sparkSession.createDataFrame([], "host string, ord struct<__log:int,index:bigint,pos:int>")
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    return first_seen(raw.select("raw", F.struct("__log", "index", "pos").alias("ord")), n)


def choose_ct_logs(lists: DataFrame, operators: list[str], now: Column) -> DataFrame:
    """(ord, url) of the logs to read (A17-A19, O12) from (operator, description, url, usable, start, end, ord).

    Operators match by case-insensitive substring of name or description; none or "all" matches each. Of an
    operator's logs: those that cover now (or have no interval), then the nearest future one within FRESH_DAYS.
    """
    tokens = [t.lower() for t in operators]
    everything = not tokens or "all" in tokens
    hit = F.lit(True) if everything else F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.lower("operator"), t) | F.contains(F.lower("description"), t))
    logs = lists.filter(F.col("usable") & hit)
    covers = F.col("start").isNull() | ((F.col("start") <= now) & (now < F.col("end")))
    current = logs.filter(covers).select("operator", F.lit(0).alias("later"), "ord", "url")
    ahead = logs.filter((F.col("start") > now) & (F.col("start") <= now + F.make_interval(days=F.lit(FRESH_DAYS))))
    nearest = ahead.groupBy("operator").agg(F.min_by(F.struct("ord", "url"), F.struct("start", "ord")).alias("l")).select("operator", F.lit(1).alias("later"), "l.ord", "l.url")
    first = logs.groupBy("operator").agg(F.min("ord").alias("__first"))
    return current.unionByName(nearest).join(first, "operator").orderBy("__first", "later", "ord").select("ord", "url")


def crtsh_names(records: DataFrame, n: int | None = None) -> DataFrame:
    """(host, ord) from certificate search records (query, idx, common_name, name_value): the name, then each line."""
    names = F.concat(F.array("common_name"), F.split(F.coalesce("name_value", F.lit("")), "\n"))
    rows = records.filter(F.col("idx") < CRTSH_RECORDS).select("query", "idx", F.posexplode(names).alias("pos", "raw")).filter("raw <> ''")
    return first_seen(rows.select("raw", F.struct("query", "idx", "pos").alias("ord")), n)


def ranked_zip(files: DataFrame, n: int) -> DataFrame:
    """(host, ord) from zipped rank lists (content): column 2 of the first n rows of the first .csv, cleaned after the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            for content in b.column(0).to_pylist():
                names: list[str] = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = next((x for x in z.namelist() if x.lower().endswith(".csv")), None)
                    if inner:
                        with z.open(inner) as f:
                            for i, row in enumerate(csv.reader(io.TextIOWrapper(f, "utf-8"))):
                                if i >= n:
                                    break
                                names.append(row[1] if len(row) > 1 else "")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(range(len(names)), pa.int64())], names=["raw", "ord"])

    return first_seen(files.select("content").mapInArrow(run, "raw string, ord bigint"), n)


#: Rows of a full page and pages read at most, of code search and of server listings. Fixed values.
SEARCH_PAGES, LISTING_PAGES = (100, 10), (100, 100)


def paged(items: DataFrame, size: int, most: int) -> DataFrame:
    """The items (page from 0, ...) that a reader of pages gets: it stops after a page that isn't full, and after ``most`` pages."""
    near = items.filter(F.col("page") < most)
    counts = {r.page: r.n for r in near.groupBy("page").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``most`` rows
    last = next((p for p in range(most) if counts.get(p, 0) < size), most)
    return near.filter(F.col("page") <= last)


def listed_by_cursor(pages: DataFrame, most: int = LISTING_PAGES[1]) -> DataFrame:
    """(page, ...) of listing pages (cursor, next_cursor, ...), followed from the empty cursor, ``most`` pages at most."""
    links = {r.cursor: r.next_cursor for r in pages.select("cursor", "next_cursor").collect()} if pages.count() <= most * 100 else None
    if links is None:
        raise ValueError("more pages than a listing can have")
    order, at = [], ""
    while at in links and len(order) < most and at not in order:
        order.append(at)
        at = links[at] or ""
        if not at:
            break
    numbers = pages.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "cursor string, page int")
    return pages.join(F.broadcast(numbers), "cursor")


def repository_hosts(items: DataFrame, n: int | None = None) -> DataFrame:
    """(host, ord) from code search items (ord, full_name, homepage)."""
    return first_seen(items.select(hosts.domain_of_repository(F.col("full_name"), F.col("homepage")).alias("raw"), F.col("ord").cast("long").alias("ord")).filter("raw IS NOT NULL"), n)


def server_hosts(servers: DataFrame, n: int | None = None) -> DataFrame:
    """(host, ord) from listed servers (ord, name, remotes): remote hosts, then the name's domain."""
    rows = servers.select("ord", F.posexplode(hosts.domains_of_server(F.col("name"), F.col("remotes"))).alias("pos", "raw"))
    return first_seen(rows.select("raw", F.struct("ord", "pos").alias("ord")), n)


def curated_hosts(texts: DataFrame, n: int | None = None) -> DataFrame:
    """(host, ord) of the URLs in list documents (ord, text), infrastructure dropped."""
    rows = texts.select("ord", F.posexplode(hosts.hosts_of_text(F.col("text"))).alias("pos", "raw"))
    return first_seen(rows.select("raw", F.struct("ord", "pos").alias("ord")), n)


def ranked_hosts(lines: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """(host, ord) from rank lines (ord, line): tab-separated, reversed host in column 5.

    Blank, # and short lines don't count; ``offset`` valid lines are skipped before hosts are cleaned and repeated ones dropped.
    """
    parts = F.split("line", "\t")
    valid = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#") & (F.size(parts) >= 5)).select("ord", hosts.reverse_host(parts[4]).alias("raw"))
    ranked = numbered(valid, ["ord"], "__rank", "ranks").filter(F.col("__rank") > offset)
    return first_seen(ranked.select("raw", F.col("__rank").alias("ord")), n)


def newest_release(releases: DataFrame) -> Column:
    """Id of the first element of a release list column ``releases``."""
    return F.element_at(F.from_json(releases["releases"], "array<struct<id:string>>"), 1)["id"]


@dataclass(frozen=True)
class Source:
    """A seed source: what reads its payload, how many hosts it gives and how many it steps over by default."""

    read: Callable[..., DataFrame]
    count: int = 1000
    offset: int = 0


#: Sources by name.
SOURCES: dict[str, Source] = {
    "ct": Source(lambda payload, n, offset, **more: ct_names(payload, more["logs"], n)),
    "crtsh": Source(lambda payload, n, offset, **more: crtsh_names(payload, n)),
    "tranco": Source(lambda payload, n, offset, **more: ranked_zip(payload, n)),
    "github": Source(lambda payload, n, offset, **more: repository_hosts(paged(payload, *SEARCH_PAGES) if "page" in payload.columns else payload, n)),
    "mcp": Source(lambda payload, n, offset, **more: server_hosts(payload, n)),
    "curated": Source(lambda payload, n, offset, **more: curated_hosts(payload, n)),
    "commoncrawl": Source(lambda payload, n, offset, **more: ranked_hosts(payload, n, offset)),
}


def build_seeder(name: str, count: int = 0, offset: int = 0, **more: object) -> Callable[[DataFrame], DataFrame]:
    """A function from a source's payload to its hosts (host, ord); a count or offset of 0 leaves the source's own.

    ValueError for an unknown name.
    """
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}: one of {', '.join(sorted(SOURCES))}")
    source = SOURCES[name]
    return lambda payload: source.read(payload, count or source.count, offset or source.offset, **more)


class NoLogs(ValueError):
    """No usable log matches the operators that were asked for."""


def need_ct_logs(lists: DataFrame, operators: list[str], now: Column) -> DataFrame:
    """``choose_ct_logs``, or NoLogs with the names of the operators that have usable logs."""
    chosen = choose_ct_logs(lists, operators, now)
    if not chosen.head(1):
        names = [r.operator for r in lists.filter("usable").select("operator").distinct().orderBy("operator").collect()]  # one row for each operator
        raise NoLogs(f"no usable log of {', '.join(operators) or 'any operator'}; operators: {', '.join(names)}")
    return chosen


def keywords(given: list[str] | None) -> list[str]:
    """The keywords of a certificate search: those given, else the default ones."""
    return [k for k in given or [] if k] or list(CRTSH_KEYWORDS)


def search_url(base: Column) -> Column:
    """Search endpoint of a registry: one trailing slash goes, /search is added unless it is there."""
    bare = F.regexp_replace(base, "/$", "")
    return F.when(bare.endswith("/search"), bare).otherwise(F.concat(bare, F.lit("/search")))
