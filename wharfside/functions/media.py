"""Media types: parsing, kind and format (H1-H5), as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind of each full type. Fixed values.
KINDS = {
    "application/ai-skill": "skill",
    "application/agent-skills": "skill",
    "application/ai-skill-archive": "skill",
    "application/mcp-server-card": "mcp-server",
    "application/mcp-server": "mcp-server",
    "application/a2a-agent-card": "a2a-agent",
    "application/a2a-agent": "a2a-agent",
    "application/ai-catalog": "catalog",
    "application/ai-registry": "registry",
    "application/json": "generic",
    "application/vnd.oai.openapi": "generic",
    "application/linkset": "generic",
    "text/markdown": "generic",
    "text/plain": "generic",
    "text/html": "generic",
}
SUFFIX_FORMATS = {"json": "json", "md": "markdown", "zip": "zip", "gzip": "gzip"}
TEXT_FORMATS = {"markdown": "markdown", "html": "html", "plain": "text"}
SKILL_PROFILE = "urn:air:agent-skills"


def parse_media(raw: Column) -> Column:
    """struct(type, base, suffix, params): lower case, suffix after the last '+', params a map of lowered names to unquoted values, the last of a name (H1)."""
    clean = F.trim(F.coalesce(raw, F.lit("")))
    full = F.lower(F.trim(F.substring_index(clean, ";", 1)))
    slash = F.when(full.contains("/"), F.substring_index(full, "/", 1)).otherwise(F.lit(""))
    rest = F.when(full.contains("/"), F.regexp_replace(full, r"^[^/]*/", "")).otherwise(full)
    suffix = F.when(rest.contains("+"), F.substring_index(rest, "+", -1)).otherwise(F.lit(""))
    base = F.when(rest.contains("+"), F.regexp_replace(rest, r"\+[^+]*$", "")).otherwise(rest)
    parts = F.filter(F.slice(F.split(clean, ";"), 2, 1_000_000), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(p, r"^[^=]*=", "")), r'^"|"$', "").alias("v")))
    # Of repeated names the last holds: names are kept where they don't occur again further on.
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.lit(1_000_000)), lambda y: y["k"] == x["k"]))
    return F.struct(slash.alias("type"), base.alias("base"), suffix.alias("suffix"), F.map_from_entries(last).alias("params"))


def full_type(parsed: Column) -> Column:
    """type/base (H2)."""
    return F.concat(parsed["type"], F.lit("/"), parsed["base"])


def profile(parsed: Column) -> Column:
    """The profile parameter, '' when absent (H4)."""
    return F.coalesce(F.element_at(parsed["params"], "profile"), F.lit(""))


def media_kind(parsed: Column) -> Column:
    """Kind by the allow-list; the skill profile makes a skill of all but catalogs and registries (H3)."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.coalesce(F.element_at(table, full_type(parsed)), F.lit("unknown"))
    return F.when(~kind.isin("catalog", "registry") & (profile(parsed) == SKILL_PROFILE), "skill").otherwise(kind)


def is_known(parsed: Column) -> Column:
    """Whether the kind is one of the list (H4)."""
    return media_kind(parsed) != "unknown"


def is_pointer(parsed: Column) -> Column:
    return media_kind(parsed).isin("catalog", "registry")


def media_format(parsed: Column) -> Column:
    """Format by suffix, else by text subtype (H5)."""
    suffixes = F.create_map(*[F.lit(x) for kv in SUFFIX_FORMATS.items() for x in kv])
    texts = F.create_map(*[F.lit(x) for kv in TEXT_FORMATS.items() for x in kv])
    by_text = F.when(parsed["type"] == "text", F.element_at(texts, parsed["base"]))
    return F.coalesce(F.element_at(suffixes, parsed["suffix"]), by_text, F.lit("unknown"))
