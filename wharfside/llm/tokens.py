"""Token counts of texts under a public tokenizer file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: File of the tokenizer: a byte-level BPE as ranks (.tiktoken) or for the ``tokenizers`` library (.json).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level BPE of this vocabulary cuts text before merging. Fixed pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts encoded together, and the characters they may have in sum before a batch is cut.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 2_000_000


@lru_cache(2)
def _ranked(path: str) -> Callable[[list[str]], list[int]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


@lru_cache(2)
def _described(path: str) -> Callable[[list[str]], list[int]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; 0 for null and empty. Whole texts are encoded."""
    count = _ranked(path) if path.endswith(".tiktoken") else _described(path)
    out: list[int] = []
    group: list[str] = []
    chars = 0
    for x in texts:
        if group and (len(group) == TEXTS_AT_ONCE or chars + len(x or "") > CHARS_AT_ONCE):
            out += count(group)
            group, chars = [], 0
        group.append(x or "")
        chars += len(x or "")
    return out + count(group) if group else out


def count_tokens(documents: DataFrame, keep: list[str], path: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens`` (bigint) of every row; only these columns and the text are read."""
    lean = documents.selectExpr(*keep, f"cast({text_col} AS string) AS __text")
    kept = lean.drop("__text").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n = pa.array(token_counts(part.column(part.num_columns - 1).to_pylist(), path), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], names=[*keep, "n_tokens"])

    return lean.mapInArrow(run, schema)
