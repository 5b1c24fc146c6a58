"""Problem 8: pages of keywords, links and product tags instead of sentences.

Method: function words and word classes are scored under a trigram model
trained on prose. Every sentence or block of lines has a perplexity; a page is
flagged when more than half of its characters lie in parts whose perplexity is
abnormally high or low. The limits are those that agree best with the raters'
votes on pages the model wasn't trained on.

The model and the limits are fitted on all labelled pages: they are read once,
in parts that are written, and each round of the fit is a pass that sums counts
of n-grams over the parts. The driver holds counts, never pages. Scoring reads
every page, whole, in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfside.llm.prose_model import CLASSES, PAIRS, Labelled, ProseModel, Round, Sums, Training, abnormal_share, read_texts, train, used_contexts
from wharfside.scratch import write_table
from wharfside.skew import numbered

#: Parts of the labelled pages that are left out in turn to fit the limits on pages that a model hasn't seen.
FOLDS = 5
#: Rounds in which the model, and those of the folds, are trained.
ROUNDS, FOLD_ROUNDS = 4, 2
#: Limits that are tried, in bits per token.
LOWS, HIGHS = np.arange(0, 1.51, 0.5), np.arange(3.5, 12.01, 0.25)
#: Texts read together, and the characters they may have in sum before a batch is cut.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 512, 2_000_000
SCHEMA = "doc_id bigint, bits_per_token double, abnormal_share double"


@dataclass
class Fitted:
    model: ProseModel | None
    low: float
    high: float


def labelled_pages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, votes) of every labelled page, votes being those for spam minus those for page.

    Undecided pages and pages without text are left out.
    """
    vote = F.when(F.col("verdict") == "spam", 1).when(F.col("verdict") == "page", -1).otherwise(0)
    votes = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(vote).alias("votes")).filter("votes <> 0")
    texts = documents.select("doc_id", "text").join(votes, "doc_id").filter("trim(text) <> ''")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("votes").alias("votes"))


@dataclass
class _Judging:
    """Votes that each pair of limits contradicts, with a model for each fold; pairs are numbered low by low."""

    models: list[ProseModel]
    width = 1

    def __call__(self, part: Labelled) -> Sums:
        bits, chars = part.bits(self.models)
        n = len(part.votes)
        shares = np.array([abnormal_share(part.read, n, bits, chars, low, high) > 0.5 for low in LOWS for high in HIGHS])
        return np.arange(len(shares)), ((shares != (part.votes > 0)) * np.abs(part.votes)).sum(axis=1)[:, None]


class _Here:
    """Labelled pages in this process, as one part."""

    def __init__(self, pages: list[tuple[str, int]]):
        votes = np.array([v for _, v in pages], dtype=np.int64)
        self.pages, self.folds = len(pages), min(FOLDS, len(pages))
        fold = np.arange(self.pages) % max(self.folds, 1)
        self.labels = [(int(k), bool(v < 0)) for k, v in zip(fold, votes, strict=True)]
        self.part = Labelled(read_texts([t for t, _ in pages]), votes, fold)

    def total(self, step: Round | _Judging) -> Sums:
        numbers, sums = step(self.part)
        if isinstance(step, Round):
            used = (numbers >= PAIRS) | np.isin(numbers // CLASSES, used_contexts(numbers, sums))
            numbers, sums = numbers[used], sums[used]
        return numbers, sums


class _Written:
    """Labelled pages of a table, read in parts that are written."""

    def __init__(self, pages: DataFrame):
        self.spark = pages.sparkSession
        there = write_table(pages.select("doc_id", "text", "votes"), "labelled")
        self.pages = there.count()
        self.folds = min(FOLDS, self.pages)
        fold = ((F.col("place") - 1) % max(self.folds, 1)).alias("fold")
        placed = numbered(there, ["doc_id"], "place", "labelled").select("text", F.col("votes").cast("long").alias("votes"), fold, "place")
        self.labels = [(r.fold, r.prose) for r in placed.select("fold", (F.col("votes") < 0).alias("prose")).distinct().collect()]  # two rows a fold
        parts = placed.repartition(max(1, -(-self.pages // TEXTS_AT_ONCE)), "place").drop("place")
        self.parts = write_table(parts.mapInArrow(_read_parts, "part binary"), "parts") if self.pages else None

    def total(self, step: Round | _Judging) -> Sums:
        assert self.parts is not None
        shared = self.spark.sparkContext.broadcast(step)
        sums = [f"s{i}" for i in range(step.width)]
        given = self.parts.mapInArrow(_stepper(shared), "number bigint, " + ", ".join(f"{s} bigint" for s in sums))
        added = write_table(given.groupBy("number").agg(*[F.sum(s).alias(s) for s in sums]), "sums")
        shared.destroy()
        if isinstance(step, _Judging):
            return _arrays(added, sums)
        # There are only so many pairs and classes; of the longer n-grams the used ones are few (see used_contexts).
        few, counts = _arrays(added.filter(F.col("number") >= PAIRS), sums)
        contexts = F.broadcast(self.spark.createDataFrame(pa.table({"context": pa.array(used_contexts(few, counts), pa.int64())})))
        context = F.expr(f"number div {CLASSES}")
        three, more = _arrays(added.filter(F.col("number") < PAIRS).join(contexts, context == F.col("context"), "left_semi"), sums)
        return np.concatenate([three, few]), np.concatenate([more, counts])


def _arrays(sums: DataFrame, columns: list[str]) -> Sums:
    """Numbers, ascending, and the sums of each."""
    found = sums.toArrow()
    numbers = found["number"].to_numpy()
    order = np.argsort(numbers)
    return numbers[order], np.stack([found[c].to_numpy() for c in columns], axis=1)[order]


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, votes, fold = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for begin, end in _groups(texts):
            part = Labelled(read_texts(texts[begin:end]), votes[begin:end], fold[begin:end])
            yield pa.RecordBatch.from_arrays([pa.array([part.packed()], pa.binary())], names=["part"])


def _stepper(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for batch in batches:
            for packed in batch.column(0):
                numbers, sums = step(Labelled.unpacked(packed.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *(pa.array(s) for s in sums.T)], names=["number", *(f"s{i}" for i in range(step.width))])

    return run


def fit(pages: list[tuple[str, int]] | DataFrame) -> Fitted:
    """Model and limits from all labelled pages, (text, votes) or a table from ``labelled_pages``; without any page labelled as prose there is no model.

    The limits are fitted in the same way on however many pages there are:
    each page is scored by a model of the pages outside its fold, with fewer
    pages than FOLDS each page being a fold of its own.
    """
    if isinstance(pages, list) and not any(v < 0 for _, v in pages):
        return Fitted(None, 0.0, float("inf"))
    labelled = _Here(pages) if isinstance(pages, list) else _Written(pages)
    if not any(prose for _, prose in labelled.labels):
        return Fitted(None, 0.0, float("inf"))
    trainings = []
    for k in [-1, *(range(labelled.folds) if labelled.pages > 1 else [])]:
        both = {prose for fold, prose in labelled.labels if fold != k} == {True, False}
        trainings.append(Training(k, (ROUNDS if k < 0 else FOLD_ROUNDS) if both else 0))
    model, *rest = train(trainings, labelled.total)
    _, wrong = labelled.total(_Judging(rest or [model]))
    return Fitted(model, *_limits(wrong.reshape(len(LOWS), len(HIGHS)), labelled.pages))


def _limits(wrong: np.ndarray, pages: int) -> tuple[float, float]:
    """The pair of limits that contradicts the fewest votes; of a plateau the middle. ``wrong``: votes against each pair."""
    low = int(np.flatnonzero((wrong == wrong.min()).any(axis=1))[0])
    flat = HIGHS[wrong[low] <= wrong.min() + 0.003 * pages]
    return float(LOWS[low]), float(np.median(flat))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are read together."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin == TEXTS_AT_ONCE or chars + len(t) > CHARS_AT_ONCE):
            yield begin, i
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _scorer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Fitted = shared.value
        model = fitted.model
        assert model is not None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _groups(texts):
                n = end - begin
                read = read_texts(texts[begin:end])
                bits, chars, tokens = model.segments(read)
                size = np.bincount(read.segment_text, weights=tokens, minlength=n)
                mean = np.bincount(read.segment_text, weights=bits * tokens, minlength=n) / np.maximum(size, 1)
                share = abnormal_share(read, n, bits, chars, fitted.low, fitted.high)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, n), pa.array(mean, pa.float64(), mask=size == 0), pa.array(share, pa.float64())], names=["doc_id", "bits_per_token", "abnormal_share"]
                )

    return run


def score_pages(documents: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, bits_per_token, abnormal_share) of every page with text.

    Null, empty and blank texts give no row; repeated rows are scored each;
    whole texts are read, however long; without a model there are no rows.
    Other columns are not read.
    """
    spark = documents.sparkSession
    lean = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text").filter("text RLIKE '\\\\S'")
    if fitted.model is None:
        return lean.limit(0).selectExpr("doc_id", "cast(null AS double) AS bits_per_token", "cast(null AS double) AS abnormal_share")
    return lean.mapInArrow(_scorer(spark.sparkContext.broadcast(fitted)), SCHEMA)


def spam_pages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the pages of which more than half is keywords, links or product tags."""
    fitted = fit(labelled_pages(documents, labels))
    return score_pages(documents, fitted).filter("abnormal_share > 0.5").select("doc_id")
