"""Export of the index: the join, its two text formats, ordered files with a summary."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wharfside.functions.exporttext import csv_line, json_line
from wharfside.tables import EXPORT_FIELDS


def export_join(entries: DataFrame, catalogs: DataFrame, domains: DataFrame) -> DataFrame:
    """The 13 export fields of each entry with its catalog and domain, plus entry_id to order by.

    Entries whose catalog or domain is missing are left out. The ten entry
    columns have '' for null; host, source URL and status stay as they are.
    """
    e, c, d = entries.alias("e"), catalogs.alias("c"), domains.alias("d")
    blank = lambda n: F.coalesce(F.col(f"e.{n}"), F.lit("")).alias(n)
    joined = e.join(c, F.col("e.catalog_id") == F.col("c.id")).join(d, F.col("c.domain_id") == F.col("d.id"))
    return joined.select(
        F.col("e.id").alias("entry_id"), F.col("d.host").alias("host"), F.col("c.source_url").alias("catalog_source_url"), F.col("c.verification_status").alias("verification_status"),
        *[blank(n) for n in ("urn", "urn_publisher", "display_name", "media_type", "ref_url", "description", "version", "source", "tags", "representative_queries")],
    )


def group_count(df: DataFrame, column: str) -> DataFrame:
    """(label, n) by one column; null and '' are each labelled '(empty)' after grouping."""
    label = F.when(F.col(column).isNull() | (F.col(column) == ""), "(empty)").otherwise(F.col(column))
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(label.alias("label"), "n")


def empty_label(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), "(empty)").otherwise(F.col(c))


def export_lines(joined: DataFrame, form: str, ordered: bool = True) -> DataFrame:
    """(entry_id, value) lines of the export in 'jsonl' or 'csv', by entry_id; CSV starts with a header, whose entry_id is null.

    The order comes from one range exchange; lines are made after it, so that its sampling reads rows only. The header is the line before the smallest id.
    """
    if form not in ("jsonl", "csv"):
        raise ValueError(f"unknown export format {form!r}: jsonl or csv")
    columns = ["entry_id", *EXPORT_FIELDS]
    rows = joined.select(*columns)
    line = (json_line if form == "jsonl" else csv_line)(EXPORT_FIELDS)
    if form == "csv":
        blank = joined.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        rows, line = rows.unionByName(blank), F.when(F.col("entry_id").isNull(), ",".join(EXPORT_FIELDS)).otherwise(line)
    if ordered or form == "csv":
        rows = rows.orderBy(F.col("entry_id").asc_nulls_first())
    return rows.select("entry_id", line.alias("value"))


def write_export(joined: DataFrame, path: str, form: str = "jsonl", ordered: bool = True) -> dict[str, Any]:
    """Write the export as text files whose names are in line order; the summary {format, out, rows}.

    Rows are counted while they are written, after the sort, whose sampling would count them again.
    """
    seen = Observation()
    export_lines(joined, form, ordered).observe(seen, F.count("entry_id").alias("rows")).select("value").write.mode("overwrite").text(path)
    return {"format": form, "out": path, "rows": seen.get["rows"]}


def small_export(rows: Iterable[dict[str, str | None]], form: str = "jsonl") -> str:
    """The export text of a few rows in memory."""
    values = [[r.get(f) or "" for f in EXPORT_FIELDS] for r in rows]
    if form == "jsonl":
        text = "".join(json.dumps(dict(zip(EXPORT_FIELDS, v, strict=True)), ensure_ascii=False, separators=(",", ":")) + "\n" for v in values)
        for sign in "<>&\u2028\u2029":
            text = text.replace(sign, f"\\u{ord(sign):04x}")
        return text
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([EXPORT_FIELDS, *values])
    return out.getvalue()
