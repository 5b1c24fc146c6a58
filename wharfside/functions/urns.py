"""Catalog URNs (G16-G19): native for ASCII publishers, an Arrow function for others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORM = r"(?is)^urn:(air|ai):(.+)$"


def ascii_domain(name: str) -> str:
    """Lowered name with every non-ASCII label as punycode; the name itself where a label can't be encoded."""
    low = name.lower()
    if low.isascii():
        return low
    try:
        return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode("ascii") for x in low.split("."))
    except UnicodeError:
        return name


def ascii_publisher(identifier: str) -> str:
    """An identifier whose publisher segment is written in ASCII; others unchanged."""
    low = identifier.lower()
    for nid in ("air", "ai"):
        prefix = f"urn:{nid}:"
        if low.startswith(prefix):
            publisher, colon, rest = identifier[len(prefix) :].partition(":")
            if publisher and not publisher.isascii():
                return identifier[: len(prefix)] + ascii_domain(publisher) + colon + rest
            break
    return identifier


@F.pandas_udf(T.StringType())
def _ascii_publishers(s: pd.Series) -> pd.Series:
    return s.map(ascii_publisher, na_action="ignore")


def with_ascii_publisher(identifier: Column) -> Column:
    """``ascii_publisher`` as a column."""
    return _ascii_publishers(identifier)


def parse_urn(identifier: Column) -> Column:
    """struct(ok, nid, publisher, namespace, name); parts are '' when the URN is malformed.

    ``urn:air:`` or ``urn:ai:`` in any case, at least publisher and name, no
    empty segment, a publisher with a dot and without white space. For
    publishers outside ASCII apply ``with_ascii_publisher`` first.
    """
    rest = F.regexp_extract(identifier, _FORM, 2)
    parts = F.split(rest, ":", -1)
    publisher = F.lower(parts[0])
    ok = F.coalesce(
        identifier.rlike(_FORM) & (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p == "") & publisher.contains(".") & ~publisher.rlike(r"[ \t\n]"), F.lit(False)
    )
    blank = lambda c: F.when(ok, c).otherwise(F.lit(""))
    middle = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), ":")
    return F.struct(
        ok.alias("ok"),
        blank(F.lower(F.regexp_extract(identifier, _FORM, 1))).alias("nid"),
        blank(publisher).alias("publisher"),
        blank(middle).alias("namespace"),
        blank(F.element_at(parts, -1)).alias("name"),
    )


def urn_text(parsed: Column) -> Column:
    """Canonical form; null for a malformed URN."""
    space = F.when(parsed["namespace"] == "", F.lit("")).otherwise(F.concat(parsed["namespace"], F.lit(":")))
    return F.when(parsed["ok"], F.concat(F.lit("urn:"), parsed["nid"], F.lit(":"), parsed["publisher"], F.lit(":"), space, parsed["name"]))
