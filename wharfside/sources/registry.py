"""Registry search pages: following page tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfside.scratch import write_table


def harvest(bases: DataFrame, pages: DataFrame, page_limit: int = 0) -> DataFrame:
    """(base_url, page_no, status, results, referrals): the pages of each registry in ``bases`` (base_url), from the empty token on.

    ``pages``: base_url, page_token, status, results, referrals, next_token. A
    walk ends at an empty next token, at a token that it has used, after
    ``page_limit`` pages (0: no limit), or at a page whose status isn't 200,
    which comes out as the last, without results. All registries advance
    together, one join for each page number.
    """
    at = bases.select("base_url").distinct().select("base_url", F.lit("").alias("token"), F.array(F.lit("")).alias("used"))
    keep = [c for c in pages.columns if c not in ("page_token", "next_token")]
    named = pages.withColumnRenamed("page_token", "token")
    found, number = None, 0
    while (page_limit <= 0 or number < page_limit) and at.head(1):
        number += 1
        hit = write_table(at.join(named, ["base_url", "token"]).select("used", *keep, "next_token"), "pages")
        part = hit.select(*keep, F.lit(number).alias("page_no"))
        found = part if found is None else found.unionByName(part)
        token = F.coalesce("next_token", F.lit(""))
        at = hit.filter((F.col("status") == 200) & (token != "") & ~F.array_contains("used", token)).select("base_url", token.alias("token"), F.concat("used", F.array(token)).alias("used"))
    if found is None:
        return pages.limit(0).select(*keep, F.lit(0).alias("page_no"))
    return found


def whole_walks(bases: DataFrame, pages: DataFrame, page_limit: int = 0) -> DataFrame:
    """(base_url): the registries of ``bases`` whose walk by ``harvest`` needs no page that is absent from ``pages``."""
    bases = bases.select("base_url").distinct()
    at = bases.select("base_url", F.lit("").alias("token"), F.array(F.lit("")).alias("used"))
    lacking, number = bases.limit(0), 0
    while (page_limit <= 0 or number < page_limit) and at.head(1):
        number += 1
        next_pages = pages.select("base_url", F.col("page_token").alias("token"), "status", F.coalesce("next_token", F.lit("")).alias("next"), F.lit(True).alias("there"))
        hit = write_table(at.join(next_pages, ["base_url", "token"], "left"), "walk")
        lacking = lacking.unionByName(hit.filter("there IS NULL").select("base_url"))
        at = hit.filter((F.col("status") == 200) & (F.col("next") != "") & ~F.array_contains("used", F.col("next"))).select("base_url", F.col("next").alias("token"), F.concat("used", F.array("next")).alias("used"))
    return bases.join(lacking, "base_url", "left_anti")
