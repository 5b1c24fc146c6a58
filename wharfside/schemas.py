"""Schemas of the index tables (fixed by the data model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside.operators.frontier import SCHEMA as FRONTIER

TABLES = {
    "frontier": FRONTIER,
    "domains": "id bigint, host string, first_seen_at timestamp, last_probed_at timestamp, discovery_source string, ard_status string, created_at timestamp, updated_at timestamp",
    "probes": "domain_id bigint, method string, url string, http_status int, content_type string, outcome string, error_detail string, probed_at timestamp",
    "catalogs": "id bigint, domain_id bigint, source_url string, parent_catalog_id bigint, spec_version string, host_display_name string, host_identifier string, raw_json string, content_hash string, fetched_at timestamp, verification_status string",
    "entries": "id bigint, catalog_id bigint, urn string, urn_publisher string, urn_namespace string, urn_name string, display_name string, media_type string, ref_url string, has_embedded_data boolean, "
    "description string, version string, entry_updated_at string, tags string, capabilities string, representative_queries string, trust_manifest string, source string, source_registry_id bigint",
    "checks": "subject_type string, subject_id bigint, check_id string, severity string, passed boolean, message string",
    "artifacts": "entry_id bigint, url string, http_status int, content_type string, raw_body binary, content_hash string, fetch_status string, fetched_at timestamp",
    "registries": "id bigint, entry_id bigint, catalog_id bigint, base_url string, harvest_status string, referral_source_id bigint",
}
RESPONSES = "url string, final_url string, status int, content_type string, body binary, error_class string"


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def schema_problems(df: DataFrame, name: str) -> list[str]:
    """How a stored table differs from the present schema: columns that it lacks or has in another type (A2)."""
    wanted = df.sparkSession.createDataFrame([], TABLES[name]).schema
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{name}.{f.name}: {have.get(f.name, 'absent')}, not {f.dataType.simpleString()}" for f in wanted.fields if have.get(f.name) != f.dataType.simpleString()]


def reconcile(spark: SparkSession, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A stored state in the present schema (A2).

    A frontier of another schema, or with keys longer than a digest, is begun
    anew, since its keys wouldn't be found again; other tables get null
    columns for those they lack, and tables that are absent are empty.
    """
    out = empty_state(spark)
    for name, df in state.items():
        if name == "frontier":
            old = schema_problems(df, name) or df.filter("length(dedup_key) > 64").head(1)
            out[name] = out[name] if old else df
        elif name in TABLES:
            columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in out[name].schema.fields]
            out[name] = df.select(*columns)
        else:
            out[name] = df
    return out
