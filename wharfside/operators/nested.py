"""Problem 2: nested catalog documents as flat, linked tables.

Method: Arrow-buffer flattening. The documents of a batch that are written in
the uniform way are read into Arrow structs and lists at once, without a
Python object for any row; the child lists' own offsets, the parent-index
kernel and vectorised takes then give every child its parent, catalog id and
path, level by level. A document that the columnar reader cannot represent
(members in other letter case, lone objects, JSON text inside strings, deeper
nesting than the schema) is decoded by itself; its lists are given offsets and
pass through the same kernels. There is no shuffle, so a folder of any size
flattens in one narrow stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfside.functions.jsontext import MISSING, as_list, member, read_json, scalar_text, unwrap

_CATALOG_TYPE = re.compile(r"\s*application/ai-catalog\s*(?:[+;].*)?", re.I | re.S)

#: Members copied to the flat tables. Fixed values.
ENTRY_MEMBERS = ["identifier", "displayName", "type", "url", "description", "version", "updatedAt"]
ATTESTATION_MEMBERS = ["type", "uri", "mediaType", "digest"]

_FIELDS = [("catalog_id", pa.int64()), ("node_kind", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("position", pa.int32())]
_TEXTS = [
    ("identifier", pa.string()), ("display_name", pa.string()), ("type", pa.string()), ("url", pa.string()), ("description", pa.string()),
    ("version", pa.string()), ("updated_at", pa.string()), ("uri", pa.string()), ("media_type", pa.string()), ("digest", pa.string()),
]
SCHEMA = (
    "catalog_id bigint, node_kind string, node_path string, parent_path string, position int, identifier string, display_name string, "
    "type string, url string, description string, version string, updated_at string, uri string, media_type string, digest string"
)


class _Level:
    """One list level: the objects of a flat child array with the link to their parents."""

    def __init__(self, lists: list[list], ids: pa.Array, prefixes: pa.Array, step: str):
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        nested = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.arange(offsets[-1])))
        parent = pc.list_parent_indices(nested)
        flat = pc.list_flatten(nested)
        position = pc.subtract(flat, pc.take(pa.array(offsets[:-1]), parent))
        values = [unwrap(v) for one in lists for v in one]
        keep = np.fromiter((isinstance(v, dict) for v in values), dtype=bool, count=len(values))
        kept = pa.array(np.flatnonzero(keep))
        self.objects: list[dict] = [v for v in values if isinstance(v, dict)]
        parent = pc.take(parent, kept)
        self.position = pc.cast(pc.take(position, kept), pa.int32())
        self.ids = pc.take(ids, parent)
        self.parents = pc.take(prefixes, parent)
        slash = pc.if_else(pc.equal(self.parents, ""), "", "/")
        self.paths = pc.binary_join_element_wise(self.parents, slash, f"{step}[", pc.cast(self.position, pa.string()), "]", "")


def _column(objects: list[dict], name: str) -> pa.Array:
    return pa.array([scalar_text(member(o, name)) for o in objects], pa.string())


def _suffixed(prefixes: pa.Array, step: str) -> pa.Array:
    slash = pc.if_else(pc.equal(prefixes, ""), "", "/")
    return pc.binary_join_element_wise(prefixes, slash, step, "")


def _rows(level: _Level, kind: str, parents: pa.Array, names: dict[str, str], wanted: bool) -> pa.RecordBatch:
    n = len(level.objects)
    fixed = [level.ids, pa.array([kind] * n, pa.string()), level.paths, parents, level.position]
    texts = [_column(level.objects, names[c]) if wanted and c in names else pa.nulls(n, t) for c, t in _TEXTS]
    return pa.RecordBatch.from_arrays([*fixed, *texts], names=[c for c, _ in _FIELDS + _TEXTS])


_ENTRY_COLUMNS = dict(zip(["identifier", "display_name", "type", "url", "description", "version", "updated_at"], ENTRY_MEMBERS, strict=True))
_ATTESTATION_COLUMNS = dict(zip(["type", "uri", "media_type", "digest"], ATTESTATION_MEMBERS, strict=True))


def _attestations(owners: list[dict], ids: pa.Array, paths: pa.Array, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The attestations below each owner (an entry or a host); ``paths`` are the owners' paths."""
    lists = []
    for o in owners:
        trust = unwrap(member(o, "trustManifest"))
        lists.append(as_list(member(trust, "attestations")) if isinstance(trust, dict) else [])
    if any(lists):
        level = _Level(lists, ids, _suffixed(paths, "trustManifest"), "attestations")
        yield _rows(level, "attestation", pc.replace_substring_regex(level.parents, r"/trustManifest$", ""), _ATTESTATION_COLUMNS, wanted)


def _hosts(catalogs: list[dict], ids: pa.Array, prefixes: pa.Array, wanted: bool) -> Iterator[pa.RecordBatch]:
    hosts = [unwrap(member(c, "host")) for c in catalogs]
    at = [i for i, h in enumerate(hosts) if isinstance(h, dict)]
    if at:
        take = pa.array(at, pa.int64())
        yield from _attestations([hosts[i] for i in at], pc.take(ids, take), _suffixed(pc.take(prefixes, take), "host"), wanted)


def _flatten_decoded(ids: pa.Array, texts: pa.Array, wanted: bool) -> Iterator[pa.RecordBatch]:
    """Documents that are decoded one by one; of any depth."""
    values = [read_json(t) for t in texts.to_pylist()]
    at = [i for i, v in enumerate(values) if v is not MISSING and isinstance(v, dict)]
    catalogs: list[dict] = [values[i] for i in at]
    keys = pc.take(ids, pa.array(at, pa.int64()))
    prefixes: pa.Array = pa.array([""] * len(at), pa.string())
    while catalogs:
        yield from _hosts(catalogs, keys, prefixes, wanted)
        level = _Level([as_list(member(c, "entries")) for c in catalogs], keys, prefixes, "entries")
        if not level.objects:
            return
        parents = pc.replace_substring_regex(level.parents, r"/data$", "")
        yield _rows(level, "entry", parents, _ENTRY_COLUMNS, wanted)
        yield from _attestations(level.objects, level.ids, level.paths, wanted)
        inner: list[tuple[int, dict]] = []
        for i, o in enumerate(level.objects):
            kind = member(o, "type")
            if isinstance(kind, str) and _CATALOG_TYPE.fullmatch(kind):
                data = unwrap(member(o, "data"))
                if isinstance(data, dict):
                    inner.append((i, data))
        take = pa.array([i for i, _ in inner], pa.int64())
        catalogs = [c for _, c in inner]
        keys = pc.take(level.ids, take)
        prefixes = _suffixed(pc.take(level.paths, take), "data")


#: Levels of embedded catalogs that the columnar reader's schema covers; deeper documents are decoded by themselves.
COLUMN_LEVELS = 4


def _catalog_type(levels: int) -> pa.DataType:
    text = pa.string()
    trust = pa.struct([("attestations", pa.list_(pa.struct([(n, text) for n in ATTESTATION_MEMBERS])))])
    entry = [(n, text) for n in ENTRY_MEMBERS] + [("trustManifest", trust)] + ([("data", _catalog_type(levels - 1))] if levels else [])
    return pa.struct([("host", pa.struct([("trustManifest", trust)])), ("entries", pa.list_(pa.struct(entry)))])


_NAMES = "|".join(dict.fromkeys(["host", "entries", "data", "trustManifest", "attestations", *ENTRY_MEMBERS, *ATTESTATION_MEMBERS]))
#: A member that the schema can't hold: a list written as an object or text, an object written as text, a text that isn't one, a name with an escape.
_UNEVEN = (
    r'"(?:entries|attestations)"\s*:\s*["{]|"(?:host|data|trustManifest)"\s*:\s*[^\s{n]|"(?:' + "|".join(dict.fromkeys(ENTRY_MEMBERS + ATTESTATION_MEMBERS)) + r')"\s*:\s*[^\s"n]|\\u[0-9a-fA-F]{4}[^"]*"\s*:'
)
_AT_ROW = re.compile(r"in row (\d+)$")


def _even(texts: pa.Array) -> np.ndarray:
    """Whether each document looks uniform; what slips through is found by the reader or by the count of lists."""
    spelled = pc.count_substring_regex(texts, f'(?i)"(?:{_NAMES})"\\s*:')
    exact = pc.count_substring_regex(texts, f'"(?:{_NAMES})"\\s*:')
    fits = pc.and_(pc.equal(spelled, exact), pc.invert(pc.match_substring_regex(texts, _UNEVEN)))
    return pc.fill_null(pc.and_(fits, pc.match_substring_regex(texts, r"^\s*\{")), False).to_numpy(zero_copy_only=False)


def _read_columns(texts: pa.Array, rows: np.ndarray, schema: pa.Schema) -> tuple[pa.StructArray | None, np.ndarray]:
    """The documents of ``rows`` as one struct array, and the rows it holds: those the reader refuses are left out."""
    options = pj.ParseOptions(explicit_schema=schema, newlines_in_values=True, unexpected_field_behavior="ignore")
    parts: list[pa.StructArray] = []
    held: list[np.ndarray] = []
    start, stop = 0, len(rows)
    while start < len(rows):
        some = rows[start:stop]
        body = "\n".join(texts.take(pa.array(some)).to_pylist()).encode("utf-8", "surrogatepass")
        try:
            read = pj.read_json(pa.BufferReader(body), read_options=pj.ReadOptions(use_threads=False, block_size=len(body) + 64), parse_options=options)
        except pa.ArrowInvalid as e:
            refused = _AT_ROW.search(str(e))
            at = int(refused[1]) if refused else 0
            if 0 < at < len(some):
                stop = start + at  # those before it are read first
            else:
                start, stop = start + 1, len(rows)
            continue
        if read.num_rows != len(some):
            break
        parts.append(pa.StructArray.from_arrays([read.column(n).combine_chunks() for n in schema.names], fields=list(schema)))
        held.append(some)
        start, stop = stop + (stop < len(rows)), len(rows)
    return (pa.concat_arrays(parts), np.concatenate(held)) if parts else (None, rows[:0])


class _Lists:
    """The objects of a list column: the column's own offsets give their position, the parent-index kernel their parent."""

    def __init__(self, lists: pa.ListArray, ids: pa.Array, prefixes: pa.Array, step: str):
        flat = pc.list_flatten(lists)
        parent = pc.list_parent_indices(lists)
        first = pc.take(lists.offsets, parent)
        position = pc.subtract(pa.array(np.arange(len(flat)), pa.int32()), pc.subtract(first, lists.offsets[0]))
        kept = pa.array(np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False)))
        self.objects = pc.take(flat, kept)
        self.position = pc.cast(pc.take(position, kept), pa.int32())
        self.owner = pc.take(parent, kept)
        self.ids, self.parents = pc.take(ids, self.owner), pc.take(prefixes, self.owner)
        slash = pc.if_else(pc.equal(self.parents, ""), "", "/")
        self.paths = pc.binary_join_element_wise(self.parents, slash, f"{step}[", pc.cast(self.position, pa.string()), "]", "")

    def rows(self, kind: str, parents: pa.Array, names: dict[str, str], wanted: bool) -> pa.RecordBatch:
        n = len(self.objects)
        texts = [pc.struct_field(self.objects, names[c]) if wanted and c in names else pa.nulls(n, t) for c, t in _TEXTS]
        return pa.RecordBatch.from_arrays([self.ids, pa.array([kind] * n, pa.string()), self.paths, parents, self.position, *texts], names=[c for c, _ in _FIELDS + _TEXTS])


def _is_catalog(types: pa.Array) -> np.ndarray:
    coded = pc.dictionary_encode(types)
    known = np.array([bool(_CATALOG_TYPE.fullmatch(t)) for t in coded.dictionary.to_pylist()] + [False])
    return known[pc.fill_null(coded.indices, len(known) - 1).to_numpy(zero_copy_only=False)]


def _found_lists(catalogs: pa.StructArray, document: np.ndarray, seen: np.ndarray) -> None:
    """Count, for each document, the entry and attestation lists in its columns, those of data that isn't searched too."""
    valid = lambda a: a.is_valid().to_numpy(zero_copy_only=False)
    while len(catalogs):
        entries = pc.struct_field(catalogs, "entries")
        seen += np.bincount(document[valid(entries)], minlength=len(seen))
        seen += np.bincount(document[valid(pc.struct_field(catalogs, ["host", "trustManifest", "attestations"]))], minlength=len(seen))
        objects, document = pc.list_flatten(entries), document[pc.list_parent_indices(entries).to_numpy()]
        seen += np.bincount(document[valid(pc.struct_field(objects, ["trustManifest", "attestations"]))], minlength=len(seen))
        if objects.type.get_field_index("data") < 0:
            return
        data = pc.struct_field(objects, "data")
        catalogs, document = data.filter(data.is_valid()), document[valid(data)]


def _flatten_columns(catalogs: pa.StructArray, ids: pa.Array, wanted: bool) -> Iterator[pa.RecordBatch]:
    prefixes: pa.Array = pa.array([""] * len(ids), pa.string())
    while len(catalogs):
        hosts = _Lists(pc.struct_field(catalogs, ["host", "trustManifest", "attestations"]), ids, _suffixed(prefixes, "host/trustManifest"), "attestations")
        if len(hosts.objects):
            yield hosts.rows("attestation", pc.replace_substring_regex(hosts.parents, r"/trustManifest$", ""), _ATTESTATION_COLUMNS, wanted)
        entries = _Lists(pc.struct_field(catalogs, "entries"), ids, prefixes, "entries")
        if not len(entries.objects):
            return
        yield entries.rows("entry", pc.replace_substring_regex(entries.parents, r"/data$", ""), _ENTRY_COLUMNS, wanted)
        own = _Lists(pc.struct_field(entries.objects, ["trustManifest", "attestations"]), entries.ids, _suffixed(entries.paths, "trustManifest"), "attestations")
        if len(own.objects):
            yield own.rows("attestation", pc.replace_substring_regex(own.parents, r"/trustManifest$", ""), _ATTESTATION_COLUMNS, wanted)
        if entries.objects.type.get_field_index("data") < 0:
            return
        data = pc.struct_field(entries.objects, "data")
        inner = pa.array(np.flatnonzero(_is_catalog(pc.struct_field(entries.objects, "type")) & data.is_valid().to_numpy(zero_copy_only=False)))
        catalogs, ids, prefixes = pc.take(data, inner), pc.take(entries.ids, inner), _suffixed(pc.take(entries.paths, inner), "data")


def _flatten(ids: pa.Array, texts: pa.Array, wanted: bool, levels: int = COLUMN_LEVELS) -> Iterator[pa.RecordBatch]:
    catalogs, rows = _read_columns(texts, np.flatnonzero(_even(texts)), pa.schema(list(_catalog_type(levels))))
    if catalogs is not None:
        written = pc.count_substring_regex(texts.take(pa.array(rows)), r'"(?:entries|attestations)"\s*:\s*\[').to_numpy(zero_copy_only=False)
        seen = np.zeros(len(rows), dtype=np.int64)
        _found_lists(catalogs, np.arange(len(rows)), seen)
        whole = np.flatnonzero(seen == written)  # lists in places that the schema doesn't know: not settled here
        rows = rows[whole]
        yield from _flatten_columns(pc.take(catalogs, pa.array(whole)), ids.take(pa.array(rows)), wanted)
    rest = pa.array(np.setdiff1d(np.arange(len(texts)), rows))
    yield from _flatten_decoded(ids.take(rest), texts.take(rest), wanted)


def _mapper(wanted: bool, rows_at_once: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                yield from _flatten(part.column(0), part.column(1), wanted)

    return run


def _reason(text: str) -> str | None:
    value = read_json(text)
    return None if isinstance(value, dict) else "not JSON" if value is MISSING else "not an object"


def unreadable(catalogs: DataFrame, id_col: str = "id", json_col: str = "raw_json") -> DataFrame:
    """(catalog_id, reason) of the documents that ``flatten_catalogs`` gives no rows for: 'null', 'not JSON' or 'not an object'.

    Depth is no reason: documents of any depth are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = pa.array([_reason(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), reasons], names=["catalog_id", "reason"])

    lean = catalogs.selectExpr(f"cast({id_col} AS bigint) AS catalog_id", f"cast({json_col} AS string) AS doc")
    read = lean.filter("doc IS NOT NULL").mapInArrow(run, "catalog_id bigint, reason string").filter("reason IS NOT NULL")
    return lean.filter("doc IS NULL").select("catalog_id", F.lit("null").alias("reason")).unionByName(read)


def flatten_catalogs(catalogs: DataFrame, id_col: str = "id", json_col: str = "raw_json", texts: bool = True) -> DataFrame:
    """One row per catalog entry and per attestation, at any depth, with the path of the node and of its parent.

    Documents that are null or not a JSON object give no row. Lists are those
    delivered: elements that are not objects keep their place in the numbering
    but give no row. Member names match in any letter case, JSON text inside a
    string counts as the value it holds, a lone object counts as a list of
    one. Rows repeat if documents repeat. Other columns of ``catalogs`` are
    not read, whatever their names. ``texts`` adds the members of each node.
    """
    lean = catalogs.selectExpr(f"cast({id_col} AS bigint) AS catalog_id", f"cast({json_col} AS string) AS doc")
    return lean.mapInArrow(_mapper(texts), SCHEMA)


def entries(flat: DataFrame) -> DataFrame:
    """The entry table of ``flatten_catalogs``."""
    return flat.filter("node_kind = 'entry'").select(
        "catalog_id", "node_path", "parent_path", "position", "identifier", "display_name", "type", "url", "description", "version", "updated_at"
    )


def attestations(flat: DataFrame) -> DataFrame:
    """The attestation table of ``flatten_catalogs``; parent_path is the entry or host it belongs to."""
    return flat.filter("node_kind = 'attestation'").select("catalog_id", "node_path", "parent_path", "position", "type", "uri", "media_type", "digest")


def found(flat: DataFrame) -> DataFrame:
    """Paths only: (catalog_id, node_path, parent_path)."""
    return flat.select("catalog_id", "node_path", "parent_path")
