"""Problem 1: records that differ only in formatting.

Method: Merkle-style hashing from the leaves up. Leaves are normalised to
their letters and digits without case, child digests are sorted at objects,
nested ones too, and keep their order at lists, records are grouped by root digest. The grouping compares the whole
normalised structure besides the digest, so equal digests of different records
stay apart.

Copies are counted before the shuffle, so a record written a billion times is
one row per task; ids come back to the rows through ``join_unique``, which
leaves the rows of hot records where they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfside.functions.jsontext import MISSING, read_json
from wharfside.scratch import write_table
from wharfside.skew import join_unique
from wharfside.tables import EXPORT_FIELDS

_ASIDE = re.compile(r"[\W_]+")
SCHEMA = "table_name string, record_id bigint, digest binary, form string"
ENTRY_FIELDS = ["urn", "display_name", "media_type", "ref_url", "description", "version"]


def normal_text(text: str) -> str:
    """The letters and digits of a text, case folded, composed; lone surrogates drop out."""
    if text.isascii():
        return _ASIDE.sub("", text.lower())
    return _ASIDE.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def node(value: Any) -> tuple[str, bytes]:
    """Structure of a value of any depth with normalised leaves, and its digest from the leaves up; '' and no digest for null, absent and empty.

    Lists keep their order and a list of scalars is the text of its values, a leaf;
    objects are unordered and drop empty members. Equal structures have equal digests.
    """
    done: list[tuple[str, bytes]] = []  # finished nodes, the children of an inner node being the last ones
    todo: list[tuple[Any, list[str] | int | None]] = [(value, None)]  # values, and inner nodes with their member names or number of items
    while todo:
        x, below = todo.pop()
        if below is None:
            if isinstance(x, dict):
                todo.append((x, [normal_text(k) for k in x]))
                todo += [(v, None) for v in reversed(x.values())]
            elif isinstance(x, list) and any(isinstance(v, (dict, list)) for v in x):
                todo.append((x, len(x)))
                todo += [(v, None) for v in reversed(x)]
            else:
                form = _leaf(x)
                done.append((form, _digest(b"=", form.encode("utf-8", "surrogatepass")) if form else b""))
            continue
        n = below if isinstance(below, int) else len(below)
        children = done[len(done) - n :] if n else []
        del done[len(done) - n :]
        if isinstance(below, int):
            parts = [c for c in children if c[0]]
            done.append(("[" + ",".join(f for f, _ in parts) + "]", _digest(b"[", *[d for _, d in parts])) if parts else ("", b""))
        else:
            members = sorted((k, *c) for k, c in zip(below, children, strict=True) if c[0])
            digests = sorted(_digest(k.encode("utf-8", "surrogatepass"), b"\x1f", d) for k, _, d in members)
            done.append(("{" + ",".join(f"{k}:{f}" for k, f, _ in members) + "}", _digest(b"{", *digests)) if members else ("", b""))
    return done[0]


def _leaf(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    if isinstance(value, str):
        return normal_text(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "".join(_leaf(v) for v in value)
    return normal_text(str(value))


def normal_form(value: Any) -> str:
    """The structure of ``node``."""
    return node(value)[0]


def merkle(children: dict[str, str], nested: dict[str, bytes] | None = None) -> bytes:
    """Root digest of an unordered node: the sorted digests of its members, each over name and normal form, or the digest in ``nested``."""
    below = nested or {}
    own = [_digest(k.encode("utf-8", "surrogatepass"), b"\x1f", below.get(k) or f.encode("utf-8", "surrogatepass")) for k, f in children.items() if f]
    return _digest(*sorted(own))


def _written(children: dict[str, str], fields: list[str]) -> str:
    """The whole normal form: the values of ``fields`` in their order, so that no names are moved."""
    return "\x1f".join([children.get(f, "") for f in fields]).rstrip("\x1f").encode("utf-8", "replace").decode("utf-8")


def _rows(name: str, ids: list[int], fields: list[str], nodes: list[dict[str, str]], nested: list[dict[str, bytes]] | None = None) -> pa.RecordBatch:
    below = nested or [{}] * len(nodes)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array([merkle({**n, "": name}, d) for n, d in zip(nodes, below, strict=True)], pa.binary()), pa.array([_written(n, fields) for n in nodes], pa.string())],
        names=["table_name", "record_id", "digest", "form"],
    )


def _of_lines(name: str, fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = {normal_text(f): f for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes, nested = [], [], []
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = read_json(line, numbers_as_text=True)
                if not isinstance(value, dict):
                    continue
                forms: dict[str, str] = {}
                digests: dict[str, bytes] = {}
                for k, v in value.items():
                    if not (field := wanted.get(normal_text(k))):
                        continue
                    form, digest = (normal_text(v), b"") if isinstance(v, str) else node(v)
                    if form:
                        forms[field] = form
                        digests[field] = digest if form[0] in "{[" else b""
                ids.append(i)
                nodes.append(forms)
                nested.append(digests)
            yield _rows(name, ids, fields, nodes, nested)

    return run


def _of_columns(name: str, exact: int, fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    places = [*(f"={i}" for i in range(exact)), *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            nodes = []
            for values in zip(*columns[1:], strict=True):
                node = {f"={i}": f"={v}" for i, v in enumerate(values[:exact]) if v is not None}
                node.update({f: normal_text(v) for f, v in zip(fields, values[exact:], strict=True) if v})
                nodes.append(node)
            yield _rows(name, columns[0], places, nodes)

    return run


def line_records(lines: DataFrame, name: str = "export_lines", id_col: str = "line_id", line_col: str = "line", fields: list[str] = EXPORT_FIELDS) -> DataFrame:
    """Digest and normal form of JSON lines. Lines that are not a JSON object (null, empty, broken) are no records.

    Of several members that name one field the last with content holds.
    """
    lean = lines.selectExpr(f"cast({id_col} AS bigint) AS record_id", f"cast({line_col} AS string) AS line").filter("record_id IS NOT NULL AND line IS NOT NULL")
    return lean.mapInArrow(_of_lines(name, fields), SCHEMA)


def column_records(rows: DataFrame, name: str, id_col: str, exact: list[str], fields: list[str]) -> DataFrame:
    """Digest and normal form of table rows; ``exact`` columns are compared as they are, null with null."""
    texts = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate([*exact, *fields])]
    lean = rows.select(F.col(id_col).cast("long").alias("record_id"), *texts).filter("record_id IS NOT NULL")
    return lean.mapInArrow(_of_columns(name, len(exact), fields), SCHEMA)


def group_records(records: DataFrame) -> DataFrame:
    """(digest, form, table_name, first_id, copies): one row per distinct record; the whole form is compared, not only the digest."""
    return records.groupBy("digest", "form", "table_name").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def distinct_records(records: DataFrame) -> DataFrame:
    """(table_name, first_id, copies): each distinct record once, with the number of its copies."""
    return group_records(records).select("table_name", "first_id", "copies")


def record_copies(records: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id): every record that isn't the smallest id of its group.

    Records without any content are copies of each other. A row that repeats
    with its id counts as a copy but gives no pair with itself. Empty input
    gives an empty result.
    """
    kept = write_table(records, "records")
    groups = group_records(kept)
    forms = groups.groupBy("digest", "table_name").agg(F.count(F.lit(1)).alias("forms"), F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    forms = write_table(forms, "digests")
    on = ["digest", "table_name"]
    lean = kept.select(*on, "record_id")
    pairs = join_unique(lean, forms.filter("forms = 1 AND copies > 1").drop("forms"), on, "copies")
    clash = forms.filter("forms > 1")
    if clash.head(1):  # equal digests of different records: told apart by their forms
        few = clash.select(*on)
        exact = groups.join(few, on, "left_semi").select(*on, "form", "first_id", "copies")
        apart = join_unique(kept.select(*on, "form", "record_id"), exact, [*on, "form"], "copies").drop("form")
        pairs = pairs.unionByName(apart)
    return pairs.filter("record_id > first_id").select("table_name", "first_id", F.col("record_id").alias("copy_id"))


def index_records(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """The records of export lines and of catalog entries."""
    return line_records(lines).unionByName(column_records(entries, "catalog_entries", "id", ["catalog_id"], ENTRY_FIELDS))
