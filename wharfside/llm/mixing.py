"""Problem 7: records of several sources mixed to target shares of tokens.

Method: soft-membership mixing. A classifier fitted on labelled rows (those
whose source is known) gives every other text a posterior over sources; a
known source is a posterior of 1. Document rates between 0 and the repeat
limit are fitted by projected gradient least squares so that the expected
tokens of each source equal the target share of the mix's size, which is the
largest size that the limits allow. Posteriors are rounded to a grid, so the
objective and its gradient depend on the documents only through the tokens of
each group of equal posterior and limit: these sums are what the distributed
pass over all documents yields, once, and the iterations run over them until
the residual stands still. Every document of a group has the group's rate.
Rates become whole repeats by a hash threshold for each mix and source that is
narrowed until the tokens meet the target; texts near the threshold then fill
what is left, those too large for it being passed over.

Repeated texts are one text: the smallest doc_id stands for all of them, so
the repeat limit holds for the text. A text of several known sources counts,
in each mix, under the one of its smallest doc_id among those that the mix names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfside.llm.tokens import TOKENIZER, token_counts
from wharfside.scratch import write_table

#: Labelled rows the classifier is fitted on at most, and characters of each used for its features only.
MAX_LABELLED = 3000
#: Width of the hashed features.
WIDTH = 1 << 12
#: Parts into which posteriors are rounded, finest first: the finest that gives at most GROUPS_MOST different posteriors is used.
GRIDS, GROUPS_MOST = (16, 8, 4, 2, 1), 200_000
#: The fit ends when the squared error of the shares is below EXACT, or when STEPS steps together have lowered it by less than the share STILL.
EXACT, STEPS, STILL = 1e-14, 200, 1e-3
#: Size of a mix as a share of the bound that the scarcest source gives, so that the projected problem has an inner solution.
BELOW = 0.999
#: Texts looked at to fill what the threshold of a mix and source leaves open.
NEAR = 512
#: Hash buckets of the rounding threshold; it is narrowed in two rounds.
BUCKETS = 4096

_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n+")


def features(text: str) -> np.ndarray:
    """Hashed, dampened and normalised word, punctuation and line-start counts of the whole text."""
    import zlib

    out = np.zeros(WIDTH, dtype=np.float32)
    start = "\n"
    for m in _WORD.finditer(text):
        w = m[0].lower()
        if w[0] == "\n":
            start = "\n" * min(2, len(w))
            continue
        if w.isdigit():
            w = "0"
        out[zlib.crc32(w.encode("utf-8", "replace")) % WIDTH] += 1
        if start:
            out[zlib.crc32((start + w).encode("utf-8", "replace")) % WIDTH] += 1
            start = ""
    np.log1p(out, out)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


@dataclass
class Classifier:
    """Softmax regression over sources; ``prior`` corrects the posterior for the shares of the sample it was fitted on."""

    sources: list[str]
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    prior: np.ndarray | None = None

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], sources: list[str], rounds: int = 150) -> Classifier:
        k = len(sources)
        at = {s: i for i, s in enumerate(sources)}
        y = np.array([at[label] for label in labels], dtype=np.int64)
        share = (np.bincount(y, minlength=k) + 1.0) / (len(y) + k)
        w, b = np.zeros((WIDTH, k), dtype=np.float32), np.log(share).astype(np.float32)
        if not len(y) or k < 2:
            return cls(sources, w, b)
        x = np.stack([features(t) for t in texts])
        onehot = np.eye(k, dtype=np.float32)[y]
        step_w, step_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):  # gradient descent with momentum and weight decay
            error = (_softmax(x @ w + b) - onehot) / len(y)
            step_w = 0.9 * step_w - 8.0 * (x.T @ error + 1e-5 * w)
            step_b = 0.9 * step_b - 8.0 * error.sum(axis=0)
            w += step_w
            b += step_b
        return cls(sources, w, b)

    def posterior(self, text: str) -> np.ndarray:
        p = _softmax((features(text) @ self.weights + self.bias)[None, :])[0].astype(np.float64)
        if self.prior is not None:
            p = p * self.prior
        return p / p.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Mix:
    """Targets of one mix over all sources: share (0 where the mix doesn't name the source) and repeat limit."""

    name: str
    share: np.ndarray
    limit: np.ndarray
    size: float = 0.0
    #: What the fit came to: steps, and the largest error of a source's expected share.
    steps: int = 0
    residual: float = 0.0


@dataclass
class Plan:
    """Fitted mixes and the documents that may be used in them, with the threshold and fill of each mix and source."""

    mixes: list[Mix]
    sources: list[str]
    grid: int
    rated: DataFrame
    cuts: dict[tuple[str, str], float]
    filled: list[tuple[str, int]]

    def texts(self) -> DataFrame:
        """(mix_name, source, doc_id, n_tokens, repeats, membership)."""
        spark = self.rated.sparkSession
        # One row for each mix and source of the targets, and at most NEAR for each: proven bounds for the broadcasts.
        cuts = F.broadcast(spark.createDataFrame([(m, s, float(t)) for (m, s), t in self.cuts.items()], "mix_name string, source string, cut double"))
        filled = F.broadcast(spark.createDataFrame(self.filled, "mix_name string, doc_id bigint").withColumn("more", F.lit(True)))
        up = (F.col("h") < F.col("cut")) | F.col("more").isNotNull()
        parts = F.map_from_arrays(F.array(*[F.lit(s) for s in self.sources]), F.transform(F.split("grp", ","), lambda x: x.cast("double") / self.grid))
        soft = F.when(F.col("grp") != "", F.map_filter(parts, lambda _, v: v > 0))
        out = self.rated.join(cuts, ["mix_name", "source"]).join(filled, ["mix_name", "doc_id"], "left").withColumn("repeats", (F.col("low") + F.when(up, 1).otherwise(0)).cast("int"))
        return out.filter("repeats > 0").select("mix_name", "source", "doc_id", "n_tokens", "repeats", soft.alias("membership"))

    def report(self) -> DataFrame:
        """(mix_name, size, steps, residual): what the fit of each mix came to."""
        return self.rated.sparkSession.createDataFrame([(m.name, float(m.size), m.steps, float(m.residual)) for m in self.mixes], "mix_name string, size double, steps int, residual double")


def _grid(sources: int) -> int:
    """Parts of the posterior grid: with g parts and k sources there are C(k + g - 1, g) posteriors."""
    return next((g for g in GRIDS if comb(sources + g - 1, g) <= GROUPS_MOST), 1)


def _rounded(posterior: np.ndarray, grid: int) -> list[int]:
    """A posterior in whole parts of the grid, by largest remainder."""
    scaled = posterior * grid
    low = np.floor(scaled).astype(int)
    for i in np.argsort(low - scaled, kind="stable")[: grid - low.sum()]:
        low[i] += 1
    return low.tolist()


def _classifier(documents: DataFrame, sources: list[str], most: int) -> Classifier:
    """Fitted on at most ``most`` rows whose source is known, as many of each source as there are, up to its part of ``most``; chosen by a hash of doc_id."""
    quota = max(1, most // len(sources))
    named = F.trim("source")
    known = documents.filter(named.isin(sources) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id", "size"))
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("source"), F.length("text").alias("size")).withColumn("rank", rank).filter(F.col("rank") <= quota)
    # At most ``most`` ids: a proven bound for the broadcast.
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("source"), "text").join(F.broadcast(chosen.select("doc_id", "source").distinct()), ["doc_id", "source"]).filter("length(text) > 0").orderBy("doc_id", "source", "text").collect()
    counts = {r.source: r.n for r in known.groupBy(named.alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Classifier.fit([r.text for r in rows], [r.source for r in rows], sources)
    sample = np.array([sum(r.source == s for r in rows) for s in sources]) + 1.0
    model.prior = (np.array([counts.get(s, 0) for s in sources]) + 1.0) / sample
    return model


def _members(documents: DataFrame, classifier: Classifier, tokenizer: str, grid: int) -> DataFrame:
    """(doc_id, source, n_tokens, grp, at) of each distinct text with tokens.

    Tokens, text key and, where the source is unknown, the posterior come from
    one narrow pass over the texts; only keys and numbers are shuffled. A text
    stands under its smallest doc_id and has the source of its smallest doc_id
    that names one of a target; without a known source it has the likeliest one and ``grp``
    holds its posterior in parts of the grid, else ''. ``at``, where it has several such sources, is its
    smallest doc_id under each source, else null. Texts whose sources no
    target names are left out.
    """
    sources = classifier.sources
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts, named = part.column(3).to_pylist(), part.column(1).to_pylist()
                guess = [None if s else ",".join(map(str, _rounded(model.posterior(t), grid))) for s, t in zip(named, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(token_counts(texts, tokenizer), pa.int64()), pa.array(guess, pa.string())],
                    names=["doc_id", "source", "text_key", "n_tokens", "guess"],
                )

    lean = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.nullif(F.trim("source"), F.lit("")).alias("source"), F.sha2(F.col("text"), 256).alias("text_key"), F.col("text").cast("string").alias("text")
    ).filter("doc_id IS NOT NULL AND length(text) > 0")
    read = lean.mapInArrow(run, "doc_id bigint, source string, text_key string, n_tokens bigint, guess string").filter("n_tokens > 0")
    firsts = [F.min(F.when(F.col("source") == s, F.col("doc_id"))).alias(f"at{i}") for i, s in enumerate(sources)]  # as many as the targets have sources
    texts = read.groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("source").alias("known"), *firsts, F.min("n_tokens").alias("n_tokens"), F.max("guess").alias("guess"),
    ).withColumn("at", F.array(*[f"at{i}" for i in range(len(sources))]))
    named = F.size(F.array_compact("at"))
    usable = texts.withColumn("named", named).filter("known = 0 OR named > 0")
    names = F.array(*[F.lit(s) for s in sources])
    parts = F.split("guess", ",").cast("array<int>")
    place = F.when(F.col("known") > 0, F.array_position("at", F.array_min("at"))).otherwise(F.array_position(parts, F.array_max(parts)))
    return write_table(
        usable.select("doc_id", F.element_at(names, place.cast("int")).alias("source"), "n_tokens", F.when(F.col("known") > 0, F.lit("")).otherwise(F.col("guess")).alias("grp"), F.when(F.col("named") > 1, F.col("at")).alias("at")), "members"
    )


def _in_mixes(members: DataFrame, mixes: list[Mix], sources: list[str]) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, grp): each text in each mix that can use it, under the source that it has there."""
    names = F.array(*[F.lit(s) for s in sources])
    rows: list[Column] = []
    for mix in mixes:
        own = F.array_min(F.array(*[F.get("at", F.lit(i)) if mix.share[i] > 0 else F.lit(None).cast("bigint") for i in range(len(sources))]))
        moved = F.col("at").isNotNull() & own.isNotNull()
        source = F.when(moved, F.get(names, (F.array_position("at", own) - 1).cast("int"))).otherwise(F.col("source"))
        rows.append(F.struct(F.lit(mix.name).alias("mix_name"), source.alias("source"), F.when(moved, own).otherwise(F.col("doc_id")).alias("doc_id")))
    wide = members.select(F.explode(F.array(*rows)).alias("m"), "n_tokens", "grp").select("m.*", "n_tokens", "grp")
    usable = F.array(*[F.concat_ws("\x1f", F.lit(m.name), F.lit(s)) for m in mixes for i, s in enumerate(sources) if m.limit[i] > 0])
    return wide.filter(F.array_contains(usable, F.concat_ws("\x1f", "mix_name", "source")))


def _fit(mix: Mix, own: np.ndarray, membership: np.ndarray, tokens: np.ndarray, total: int | None) -> np.ndarray:
    """Rates of the groups of a mix, between 0 and the limit of each group's source ``own``.

    Accelerated projected gradient of the squared error of the sources'
    expected shares, with the step that the largest eigenvalue allows and a
    restart where the error would rise. It ends when the error stands still.
    Groups that may belong to a source that the mix doesn't name have rate 0.
    """
    named = mix.share > 0
    limit = np.where((membership[:, ~named] > 0).any(axis=1), 0.0, mix.limit[own])
    stock = (tokens * limit) @ membership
    most = float(np.min(stock[named] / mix.share[named])) if named.any() and len(own) else 0.0
    mix.size = min(float(total), most * BELOW) if total else most * BELOW
    if mix.size <= 0:
        return np.zeros(len(own))
    a = membership.T * (tokens * limit / mix.size)  # expected share of each source for a group at its limit
    step = 1.0 / float(np.linalg.eigvalsh(a @ a.T)[-1])
    x = ahead = np.full(len(own), 0.5)
    error = lambda v: float(((a @ v - mix.share) ** 2).sum())
    now = last = error(x)
    momentum = 1.0
    while now > EXACT:
        new = np.clip(ahead - step * (a.T @ (a @ ahead - mix.share)), 0.0, 1.0)
        if error(new) > now and momentum > 1.0:
            ahead, momentum = x, 1.0
            continue
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + (momentum - 1) / after * (new - x)
        x, momentum, now = new, after, min(now, error(new))
        mix.steps += 1
        if mix.steps % STEPS == 0:
            if now > last * (1 - STILL):
                break
            last = now
    mix.residual = float(np.abs(a @ x - mix.share).max())
    return x * limit


def _rates(wide: DataFrame, mixes: list[Mix], sources: list[str], grid: int, total: int | None) -> list[tuple[str, str, str, float]]:
    """(mix_name, source, grp, rate) of every group; the groups number at most GROUPS_MOST and the sources, whatever the data."""
    groups = wide.groupBy("mix_name", "source", "grp").agg(F.sum("n_tokens").alias("tokens")).collect()
    out = []
    for mix in mixes:
        mine = sorted((r.source, r.grp, r.tokens) for r in groups if r.mix_name == mix.name)
        own = np.array([sources.index(s) for s, _, _ in mine], dtype=np.int64)
        membership = np.zeros((len(mine), len(sources)))
        for i, (_, grp, _) in enumerate(mine):
            membership[i] = np.array(grp.split(","), dtype=float) / grid if grp else np.eye(len(sources))[own[i]]
        rates = _fit(mix, own, membership, np.array([t for _, _, t in mine], dtype=float), total)
        out += [(mix.name, s, g, float(rate)) for (s, g, _), rate in zip(mine, rates, strict=True)]
    return out


def _thresholds(rated: DataFrame) -> tuple[dict[tuple[str, str], float], list[tuple[str, int]]]:
    """For each mix and source the threshold below which a text gets one more repeat, and (mix_name, doc_id) of the texts that fill the rest.

    Two rounds of bounded histograms narrow the threshold; then at most NEAR texts above it are looked at, in hash
    order, and those that still fit are taken.
    """
    spark = rated.sparkSession
    key = ["mix_name", "source"]
    span: dict[tuple[str, str], tuple[float, float]] = {}
    gap: dict[tuple[str, str], float] = {}
    near: dict[tuple[str, str], float] = {}
    for narrow in (False, True):
        inside = rated
        low, high = F.lit(0.0), F.lit(4.0)
        if narrow:
            bounds = spark.createDataFrame([(m, s, lo, hi) for (m, s), (lo, hi) in span.items()], "mix_name string, source string, lo double, hi double")
            inside, low, high = rated.join(F.broadcast(bounds), key), F.col("lo"), F.col("hi")
        bucket = F.when((F.col("h") >= low) & (F.col("h") < high), F.least(F.floor((F.col("h") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(-1).cast("int")
        sums = [F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("n_tokens") * F.col("part")).alias("open")]
        tokens: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros((BUCKETS, 2)))
        whole: dict[tuple[str, str], float] = defaultdict(float)
        for r in inside.groupBy(*key, bucket.alias("k")).agg(*sums).collect():  # at most BUCKETS + 1 rows for each target
            whole[r.mix_name, r.source] += r.open
            if r.k >= 0:
                tokens[r.mix_name, r.source][r.k] = r.t, r.n
        for k in whole:
            if not narrow:
                gap[k], span[k] = whole[k], (0.0, 4.0)
            lo, hi = span[k]
            sums_now = np.cumsum(tokens[k][:, 0])
            full = int(np.searchsorted(sums_now, gap[k], side="right"))  # buckets taken whole
            gap[k] -= float(sums_now[full - 1]) if full else 0.0
            width = (hi - lo) / BUCKETS
            span[k] = (lo + full * width, lo + min(full + 1, BUCKETS) * width)
            last = full + int(np.searchsorted(np.cumsum(tokens[k][full:, 1]), NEAR, side="right"))
            if last < BUCKETS or not narrow:
                near[k] = lo + max(last, full + 1) * width
    bounds = spark.createDataFrame([(m, s, lo, max(near[m, s], hi)) for (m, s), (lo, hi) in span.items()], "mix_name string, source string, lo double, hi double") if span else None
    filled: list[tuple[str, int]] = []
    if bounds is not None:
        first = Window.partitionBy(*key).orderBy("h", "doc_id")
        some = rated.join(F.broadcast(bounds), key).filter("h >= lo AND h < hi").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= NEAR)
        for r in sorted(some.select(*key, "doc_id", "n_tokens", "h").collect(), key=lambda r: (r.mix_name, r.source, r.h, r.doc_id)):  # at most NEAR rows for each target
            if r.n_tokens <= gap[r.mix_name, r.source] + 0.5:
                gap[r.mix_name, r.source] -= r.n_tokens
                filled.append((r.mix_name, r.doc_id))
    return {k: lo for k, (lo, _) in span.items()}, filled


def plan_mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, most: int = MAX_LABELLED) -> Plan | None:
    """The fitted mixes of ``mix_sources``; None where no target is usable."""
    valid = targets.filter("mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    wanted = valid.groupBy("mix_name", "source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("limit")).collect()
    if not wanted:
        return None
    spark = documents.sparkSession
    sources = sorted({r.source for r in wanted})
    mixes = []
    for name in sorted({r.mix_name for r in wanted}):
        share, limit = np.zeros(len(sources)), np.zeros(len(sources))
        for r in wanted:
            if r.mix_name == name:
                share[sources.index(r.source)], limit[sources.index(r.source)] = r.share, r["limit"]
        mixes.append(Mix(name, share / share.sum(), limit))
    grid = _grid(len(sources))
    wide = _in_mixes(_members(documents, _classifier(documents, sources, most), tokenizer, grid), mixes, sources)
    rates = spark.createDataFrame(_rates(wide, mixes, sources, grid, total), "mix_name string, source string, grp string, rate double")
    rate, low = F.col("rate"), F.floor(F.col("rate") + 1e-9)
    part = F.when(rate - low > 1e-9, rate - low).otherwise(0.0)
    # A document is rounded up when its hash, stretched by its fraction, falls below the threshold of its mix and source.
    u = F.pmod(F.xxhash64("mix_name", "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # The rates number at most GROUPS_MOST for each mix: a proven bound for the broadcast.
    rated = wide.join(F.broadcast(rates), ["mix_name", "source", "grp"]).filter("rate > 1e-9").withColumns({"low": low.cast("int"), "part": part})
    rated = rated.select("mix_name", "source", "doc_id", "n_tokens", "grp", "low", "part", F.when(F.col("part") > 0, F.least(u / F.greatest("part", F.lit(1e-12)), F.lit(1e6))).otherwise(1e6).alias("h"))
    rated = write_table(rated, "rates")
    return Plan(mixes, sources, grid, rated, *_thresholds(rated))


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, most: int = MAX_LABELLED) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats, membership): the texts of each mix and how often each is used.

    ``source`` is the document's own or, where it has none, the likeliest one;
    ``membership`` is its posterior then (source to weight), else null.
    Without ``total`` a mix is as large as the repeat limits allow. Texts that
    are null, empty or of no tokens can't be used; repeated texts count as
    one, under a source that the mix names if any of theirs is. Sources that a mix doesn't name are not used in it. Targets with a
    null name, source, share or limit, or a share or limit of 0, are left out;
    several rows of one mix and source add their shares and take the smaller
    limit. A text of unknown source is not used in a mix that doesn't name all the sources
    it may have. Empty tables give an empty result.
    """
    plan = plan_mix(documents, targets, tokenizer, total, most)
    if plan is None:
        return documents.sparkSession.createDataFrame([], "mix_name string, source string, doc_id bigint, n_tokens bigint, repeats int, membership map<string,double>")
    return plan.texts()


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, expected_share, tokens, texts, most_repeats): what a mix came to.

    ``actual_share`` counts every text under its source, ``expected_share`` a
    text of unknown source under all its sources, by weight.
    """
    size = F.col("n_tokens") * F.col("repeats")
    own = mixed.groupBy("mix_name", "source").agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("repeats").alias("most_repeats"))
    soft = mixed.select("mix_name", size.alias("t"), F.explode(F.coalesce("membership", F.create_map("source", F.lit(1.0)))).alias("source", "w"))
    expected = soft.groupBy("mix_name", "source").agg(F.sum(F.col("t") * F.col("w")).alias("expected"))
    whole = own.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    goal = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda c: F.coalesce(F.col(c) / F.col("all_tokens"), F.lit(0.0))
    return goal.join(own, ["mix_name", "source"], "left").join(expected, ["mix_name", "source"], "left").join(whole, "mix_name", "left").select(
        "mix_name", "source", "target_share", share("tokens").alias("actual_share"), share("expected").alias("expected_share"), zero("tokens"), zero("texts"), zero("most_repeats")
    )


def mix_invariants(mixed: DataFrame, documents: DataFrame, targets: DataFrame, within: float = 0.001) -> DataFrame:
    """(mix_name, shares_met, limits_kept, texts_once, sources_named): whether each usable mix keeps what it promises.

    Shares are met when each expected share is ``within`` of its target; texts are once when no two rows of a mix have the same text.
    """
    shares = mix_shares(mixed, targets).groupBy("mix_name").agg(
        F.max(F.abs(F.col("expected_share") - F.col("target_share"))).alias("off")
    )
    limits = targets.groupBy("mix_name", "source").agg(F.min("max_repeats").alias("most"))
    held = mixed.join(limits, ["mix_name", "source"], "left").groupBy("mix_name").agg(
        F.coalesce(F.bool_and(F.col("repeats").between(1, F.col("most"))), F.lit(False)).alias("limits_kept"), F.bool_and(F.col("most").isNotNull()).alias("sources_named")
    )
    keys = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("k"))
    once = mixed.join(keys, "doc_id").groupBy("mix_name", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("mix_name").agg((F.max("n") == 1).alias("texts_once"))
    return shares.join(held, "mix_name").join(once, "mix_name").select("mix_name", (F.col("off") <= within).alias("shares_met"), "limits_kept", "texts_once", "sources_named")
