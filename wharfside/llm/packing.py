"""Problem 6: texts packed into containers of a fixed number of tokens.

Method: exact-complement hashing. Items of one length are interchangeable, so
the packing is planned on the histogram of lengths, which has at most
``capacity`` entries however many texts there are. Sums of one, two and three
available lengths are indexed as bit sets; from the longest length down each
gap is closed exactly by a single, pair or triple of lengths, as often as all
of them are available. What cannot be closed exactly goes through best fit.

The plan is a list of rules "take the length's items number a to b, one (or
more) to each of the containers from c on"; its size depends on the number of
distinct lengths, not of texts. Texts find their container by their number within their length,
which is dealt out in parallel, so neither a text nor a container passes
through the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfside.llm.tokens import TOKENIZER, count_tokens
from wharfside.scratch import write_table
from wharfside.skew import rank_in_group


@dataclass
class Plan:
    """Rules of one capacity; containers are numbered from 1."""

    capacity: int
    containers: int = 0
    #: (length, first item, items, first container, items of this length to each container)
    rules: list[tuple[int, int, int, int, int]] = field(default_factory=list)


class _Stock:
    """Items still available by length, with the number already dealt out."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = dict(counts)
        self.used: dict[int, int] = defaultdict(int)
        self.capacity = capacity
        self.single = sum(1 << n for n in self.left)
        self._pairs: int | None = None

    def take(self, length: int, n: int) -> int:
        """The number of the first of ``n`` items taken."""
        first = self.used[length] + 1
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.single &= ~(1 << length)
        return first

    def pair_sums(self, fresh: bool = False) -> int:
        """Bit set of the sums of two available lengths. It may keep sums that are used up; a look-up checks them."""
        if self._pairs is None or fresh:
            mask, bits = (1 << (self.capacity + 1)) - 1, 0
            for n in self.left:
                bits |= (self.single << n) & mask
            self._pairs = bits
        return self._pairs


def _bits(x: int) -> list[int]:
    """Positions of the set bits, highest first."""
    out = []
    while x:
        n = x.bit_length() - 1
        out.append(n)
        x ^= 1 << n
    return out


def _mirror(x: int, gap: int) -> int:
    """Bit n of the result is bit gap - n of x."""
    x &= (1 << (gap + 1)) - 1
    return int(format(x, f"0{gap + 1}b")[::-1], 2)


def _pair(stock: _Stock, gap: int) -> list[int] | None:
    both = stock.single & _mirror(stock.single, gap)
    while both:
        n = both.bit_length() - 1
        if n * 2 < gap:
            return None
        if n * 2 != gap or stock.left.get(n, 0) >= 2:
            return [n, gap - n]
        both ^= 1 << n
    return None


#: Failed look-ups after which the index of pair sums is built anew.
STALE = 16


def _complement(stock: _Stock, gap: int) -> list[int] | None:
    """One, two or three available lengths whose sum is ``gap``, longest first."""
    if stock.left.get(gap, 0) > 0:
        return [gap]
    pairs = stock.pair_sums()
    if pairs >> gap & 1 and (found := _pair(stock, gap)):
        return found
    third = stock.single & _mirror(pairs, gap)
    failed = 0
    while third:
        n = third.bit_length() - 1
        if 3 * n < gap:
            return None
        third ^= 1 << n
        stock.left[n] -= 1
        if not stock.left[n]:
            stock.single &= ~(1 << n)
        found = _pair(stock, gap - n)
        stock.left[n] += 1
        stock.single |= 1 << n
        if found:
            return [n, *found]
        failed += 1
        if failed == STALE:
            third &= _mirror(stock.pair_sums(fresh=True), gap)
    return None


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Containers for ``counts[length]`` items of each length from 1 to ``capacity``."""
    plan = Plan(capacity)
    stock = _Stock({n: c for n, c in counts.items() if c > 0}, capacity)
    leftover: dict[int, int] = {}
    while stock.left:
        longest = stock.single.bit_length() - 1
        gap = capacity - longest
        if gap == 0:
            n = stock.left[longest]
            plan.rules.append((longest, stock.take(longest, n), n, plan.containers + 1, 1))
            plan.containers += n
            continue
        stock.left[longest] -= 1  # the item whose gap is to be closed is not available for closing it
        if not stock.left[longest]:
            stock.single &= ~(1 << longest)
        found = _complement(stock, gap)
        stock.left[longest] += 1
        stock.single |= 1 << longest
        if found is None:
            leftover[longest] = stock.left[longest]
            del stock.left[longest]
            stock.single &= ~(1 << longest)
            continue
        need: dict[int, int] = defaultdict(int)
        for n in [longest, *found]:
            need[n] += 1
        times = min(stock.left[n] // k for n, k in need.items())
        for n, k in need.items():
            plan.rules.append((n, stock.take(n, times * k), times * k, plan.containers + 1, k))
        plan.containers += times
    _best_fit(plan, leftover, stock.used)
    return plan


def _best_fit(plan: Plan, items: dict[int, int], used: dict[int, int]) -> None:
    """Best fit decreasing, all items of a length and all containers of a gap at once."""
    open_by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges (first container, number)
    gaps = 0
    for length in sorted(items, reverse=True):
        left = items[length]

        def put(first: int, n: int, each: int, length: int = length) -> None:
            plan.rules.append((length, used[length] + 1, n * each, first, each))
            used[length] += n * each

        while left:
            fitting = (gaps >> length) << length
            if not fitting:
                each = plan.capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        put(plan.containers + 1, n, k)
                        gap = plan.capacity - k * length
                        if gap:
                            open_by_gap[gap].append((plan.containers + 1, n))
                            gaps |= 1 << gap
                        plan.containers += n
                left = 0
                continue
            gap = (fitting & -fitting).bit_length() - 1
            first, n = open_by_gap[gap].pop()
            each = min(gap // length, left)
            m = min(n, left // each)
            put(first, m, each)
            left -= m * each
            if m < n:
                open_by_gap[gap].append((first + m, n - m))
            if not open_by_gap[gap]:
                gaps &= ~(1 << gap)
            rest = gap - each * length
            if rest:
                open_by_gap[rest].append((first, m))
                gaps |= 1 << rest


def _pieces(sized: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(capacity_id, doc_id, piece_no, token_start, n_tokens): a text longer than a container as full pieces and a rest."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("long").alias("room")) for i, c in capacities.items()]))
    wide = sized.select("doc_id", F.col("n_tokens").alias("whole"), each.alias("c")).select("doc_id", "whole", "c.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("whole") / F.col("room")) - 1).cast("long")
    cut = wide.select("capacity_id", "doc_id", "whole", "room", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    start = F.col("k") * F.col("room")
    return cut.select(
        "capacity_id", "doc_id", (F.col("k") + 1).cast("int").alias("piece_no"), start.alias("token_start"), F.least("room", F.col("whole") - start).alias("n_tokens")
    )


def pack_texts(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece_no, token_start, n_tokens): the contents of every container.

    Every row of ``documents`` comes out once for each capacity, repeated
    texts too; a row whose text alone exceeds the capacity comes out in pieces
    of a whole container and one rest, piece_no from 1. Texts of no tokens
    (null, empty) need no container and have a null container_id. Capacities
    that are null or below 1 are left out; of several rows of one capacity_id
    the smallest capacity holds. The capacities and the histogram of lengths
    (at most the largest capacity for each) are collected; nothing else is.
    """
    spark = documents.sparkSession
    rooms = capacities.filter("capacity_id IS NOT NULL AND capacity_tokens > 0").groupBy("capacity_id").agg(F.min("capacity_tokens").alias("c"))
    room = {int(r.capacity_id): int(r.c) for r in rooms.orderBy("capacity_id").collect()}
    sized = count_tokens(documents, ["cast(doc_id AS bigint) AS doc_id"], tokenizer) if room else documents.selectExpr("doc_id", "0L AS n_tokens").limit(0)
    pieces = write_table(_pieces(sized, room or {0: 1}), "pieces")
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in pieces.filter("n_tokens > 0").groupBy("capacity_id", "n_tokens").count().collect():
        counts[r.capacity_id][r.n_tokens] = r["count"]
    rules = [(i, *rule) for i, c in counts.items() for rule in plan_packing(c, room[i]).rules]
    numbered = rank_in_group(pieces.filter("n_tokens > 0"), ["capacity_id", "n_tokens"], ["doc_id", "piece_no"], "item", "items")
    dealt = _dealt(numbered, rules)
    none = pieces.filter("n_tokens <= 0").select("capacity_id", F.lit(None).cast("bigint").alias("container_id"), "doc_id", "piece_no", "token_start", "n_tokens")
    return dealt.unionByName(none)


_DEALT = "capacity_id int, container_id bigint, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"
#: Bits for an item's number within its length; capacity and length share the rest of a 63-bit key.
_ITEM_BITS = 44


def _dealt(numbered: DataFrame, rules: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Give each item the container of the rule its number falls under, by binary search in the sorted rules.

    Rules number a few for each length, and lengths at most the capacity: a proven bound for the broadcast.
    """
    table = np.array(sorted(rules) or [(0, 0, 0, 0, 0, 1)], dtype=np.int64)
    ids = sorted(set(table[:, 0].tolist()))
    shared = numbered.sparkSession.sparkContext.broadcast((ids, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = shared.value
        code = {i: k for k, i in enumerate(ids)}
        longest = int(table[:, 1].max()) + 1

        def key(capacity: np.ndarray, length: np.ndarray, item: np.ndarray) -> np.ndarray:
            which = np.array([code[i] for i in capacity.tolist()], dtype=np.int64)
            return ((which * longest + length) << _ITEM_BITS) + item

        keys = key(table[:, 0], table[:, 1], table[:, 2])
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            item = col["item"].to_numpy()
            rule = table[np.searchsorted(keys, key(col["capacity_id"].to_numpy(), col["n_tokens"].to_numpy(), item), side="right") - 1]
            container = rule[:, 4] + (item - rule[:, 2]) // rule[:, 5]
            yield pa.RecordBatch.from_arrays(
                [col["capacity_id"], pa.array(container), col["doc_id"], col["piece_no"], col["token_start"], col["n_tokens"]],
                names=["capacity_id", "container_id", "doc_id", "piece_no", "token_start", "n_tokens"],
            )

    lean = numbered.select("capacity_id", "doc_id", "piece_no", "token_start", "n_tokens", "item")
    return lean.mapInArrow(run, _DEALT)


def container_fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, containers, items, tokens, unused_tokens, fill) of a packing."""
    total = packed.filter("container_id IS NOT NULL").groupBy("capacity_id").agg(
        F.max("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens")
    )
    rooms = capacities.filter("capacity_id IS NOT NULL AND capacity_tokens > 0").groupBy("capacity_id").agg(F.min("capacity_tokens").cast("long").alias("room"))
    whole = F.col("containers") * F.col("room")
    return total.join(rooms, "capacity_id").select("capacity_id", "containers", "items", "tokens", (whole - F.col("tokens")).alias("unused_tokens"), (F.col("tokens") / whole).alias("fill"))
