"""Problem 5 where every owner has snapshots of its own: successive documents of one address. See ``snapshots`` for tables.

Method: the records of all snapshots are range-partitioned and sorted by key,
so that every range holds the same key interval of each snapshot, and each
range is merged in one streaming pass: neighbours of the sorted stream are the
two pointers. Only fingerprints move, never whole records. A key with very
many snapshots is cut into blocks of consecutive snapshots; the last record
before a block is repeated in it, so no comparison is lost and no range grows
with the number of snapshots of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfside.functions.jsontext import MISSING, as_list, canonical, digest, member, read_json, scalar_text, unwrap
from wharfside.scratch import write_table
from wharfside.skew import rank_in_group

#: Consecutive snapshots of one key that stay in one range.
BLOCK = 4096
SCHEMA = "snapshot_id bigint, owner string, urn string, change_kind string, changed_fields bigint"
_NONE = -(2**62)


def _merger(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge one sorted range. Columns: owner, urn, block, seq, snapshot_id, next_id, whole, parts.

    The range is sorted by (owner, urn, block, seq). Each row is compared with
    its predecessor in the stream; the last row of a batch waits for the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first = waiting is None or waiting.num_rows == 1
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            yield from _compare(batch, batch.num_rows - 1, first, block)
            waiting = batch.slice(max(0, batch.num_rows - 2))
        if waiting is not None:
            yield from _compare(waiting, waiting.num_rows, waiting.num_rows == 1, block)

    return run


def _same_as_before(column: pa.Array) -> np.ndarray:
    """Whether each value equals the one before it, null equal to null; false for the first."""
    out = np.zeros(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        out[1:] = pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)
    return out


def _compare(batch: pa.RecordBatch, upto: int, first: bool, size: int) -> Iterator[pa.RecordBatch]:
    """Changes that rows before ``upto`` give; row 0 is only context unless ``first``. ``size``: snapshots in a block."""
    n = batch.num_rows
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    same_key = _same_as_before(col["owner"]) & _same_as_before(col["urn"]) & _same_as_before(col["block"])
    seq = col["seq"].to_numpy(zero_copy_only=False)
    block = col["block"].to_numpy(zero_copy_only=False)
    halo = (seq - 1) // size != block  # repeated from the block before
    follows = same_key & (np.diff(seq, prepend=_NONE) == 1)
    now = np.arange(n) >= (0 if first else 1)
    now &= np.arange(n) < upto
    equal = _same_as_before(col["whole"])
    added = now & ~halo & ~follows & (seq > 1)
    changed = now & ~halo & follows & ~equal
    next_id = col["next_id"]
    followed = np.append(follows[1:], False)
    # A record is gone after seq when its successor isn't there; the comparison belongs to the block of the successor.
    gone = now & ~followed & pc.is_valid(next_id).to_numpy(zero_copy_only=False) & ((seq // size) == block)
    parts = col["parts"]
    for kind, at, ids in (("added", added, col["snapshot_id"]), ("changed", changed, col["snapshot_id"]), ("removed", gone, next_id)):
        where = np.flatnonzero(at)
        if not len(where):
            continue
        take = pa.array(where)
        mask = pa.array(_changed_mask(parts, where), pa.int64()) if kind == "changed" else pa.nulls(len(where), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(take), col["owner"].take(take), col["urn"].take(take), pa.array([kind] * len(where), pa.string()), mask],
            names=["snapshot_id", "owner", "urn", "change_kind", "changed_fields"],
        )


def _changed_mask(parts: pa.Array, where: np.ndarray) -> list[int | None]:
    """Bit i set where field i differs from the row before; null where fields aren't told apart."""
    new, old = parts.take(pa.array(where)).to_pylist(), parts.take(pa.array(where - 1)).to_pylist()
    return [None if a is None or b is None else sum(1 << i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y) for a, b in zip(new, old, strict=True)]


def merge_snapshots(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """Typed changes of ``records``: owner, urn, seq, snapshot_id, next_id, whole, parts.

    One row per key (owner, urn; nulls are a key like any other) and snapshot.
    ``seq`` numbers an owner's snapshots from 1 without gaps, ``next_id`` is
    the id of the following snapshot (null for the last), ``whole`` the
    fingerprint that decides a change, ``parts`` one fingerprint per field or
    null. ``records`` is read twice (for the range bounds) and should be a
    written table.
    """
    last = (F.col("seq") - 1) % block == block - 1
    own = F.floor((F.col("seq") - 1) / block).cast("long")
    blocks = F.when(last & F.col("next_id").isNotNull(), F.array(own, own + 1)).otherwise(F.array(own))
    keyed = records.select("owner", "urn", F.explode(blocks).alias("block"), "seq", "snapshot_id", "next_id", "whole", "parts")
    ranges = keyed.repartitionByRange("owner", "urn", "block").sortWithinPartitions("owner", "urn", "block", "seq")
    return ranges.mapInArrow(_merger(block), SCHEMA)


def _catalog_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, raw_json) to (id, urn, whole); a valid document gives one row with null whole besides those of its entries."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, urns, wholes = [], [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                doc = read_json(text)
                if not isinstance(doc, dict):
                    continue
                ids.append(i)
                urns.append(None)
                wholes.append(None)
                entries: dict[str | None, list[str]] = {}
                for e in map(unwrap, as_list(member(doc, "entries"))):
                    if isinstance(e, dict):
                        entries.setdefault(scalar_text(member(e, "identifier")), []).append(canonical(e))
                for urn, values in entries.items():
                    ids.append(i)
                    urns.append(urn)
                    wholes.append(digest("\x1e".join(sorted(set(values)))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urns, pa.string()), pa.array(wholes, pa.binary())], names=["id", "urn", "whole"])


def catalog_changes(catalogs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Changes of top-level entries between successive valid documents of one source_url, by fetched_at, then id.

    Documents that are null or not a JSON object are no snapshots; documents
    without a source_url are compared with each other under a null owner. An
    entry's value is its JSON value without order of members; several entries
    of one identifier count as the set of their values. Entries without an
    identifier are compared under a null urn.
    """
    lean = catalogs.selectExpr("cast(id AS bigint) AS id", "cast(raw_json AS string) AS doc")
    read = write_table(lean.mapInArrow(_catalog_rows, "id bigint, urn string, whole binary"), "entries")
    docs = read.filter("whole IS NULL").select("id").join(catalogs.select("id", F.col("source_url").alias("owner"), "fetched_at"), "id")
    ranked = write_table(rank_in_group(write_table(docs, "documents"), ["owner"], ["fetched_at", "id"], "seq"), "sequence")
    # The successor of document k of an owner is its document k + 1: found by an equi-join, not by a window over the owner.
    after = ranked.select(F.col("owner").alias("o"), (F.col("seq") - 1).alias("s"), F.col("id").alias("next_id"))
    linked = ranked.join(after, F.col("owner").eqNullSafe(F.col("o")) & (F.col("seq") == F.col("s")), "left").drop("o", "s")
    records = read.filter("whole IS NOT NULL").join(linked, "id")
    records = records.select("owner", "urn", "seq", F.col("id").alias("snapshot_id"), "next_id", "whole", F.lit(None).cast("array<bigint>").alias("parts"))
    return merge_snapshots(write_table(records, "versions"), block)
