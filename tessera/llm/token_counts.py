"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

Each text is cut into pieces; each distinct piece of a worker's table is merged
once (pop the lowest-rank adjacent pair, again and again) and its count, the
initial symbols minus the merges, is added for each occurrence. No identifiers
are made. The plan is one scan and one Arrow map: no shuffle, whatever the size.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special string
inside a text counts one token; repeated rows each give a row; a null doc_id is
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import arrays
from tessera.llm.bpe import Bpe, Words, batches

LIMIT = 1024
#: Pieces in each half of a worker's table: small integers, about 100 bytes a piece.
COUNTS = 600_000
_models: dict[str, tuple[Bpe, Words, re.Pattern | None]] = {}
arrays.caches.append(_models.clear)


def model(path: str) -> tuple[Bpe, Words, re.Pattern | None]:
    """The tokenizer of a worker process, read once."""
    if path not in _models:
        bpe = Bpe(path)
        names = sorted(bpe.special, key=len, reverse=True)
        _models[path] = bpe, Words(lambda piece: bpe.count(piece.encode()), True, COUNTS), re.compile("|".join(map(re.escape, names))) if names else None
    return _models[path]


def count_texts(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text."""
    _, table, special = model(path)
    out, parts, rows = np.zeros(len(texts), np.int64), [], []
    for k, t in enumerate(texts):
        if not t:
            continue
        if special is not None and "<" in t and (own := special.split(t))[1:]:
            out[k] += len(own) - 1
            parts += own
            rows += [k] * len(own)
        else:
            parts.append(t)
            rows.append(k)
    at = np.array(rows, np.int64)
    for i, j in batches(parts):
        entries, which, part = table.table(parts[i:j])
        if entries:
            out += np.bincount(at[i:j][part], weights=np.array(entries, np.float64)[which], minlength=len(out)).astype(np.int64)
    return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""

    def run(parts):
        for b in parts:
            texts = b.column(1).to_pylist()
            n = count_texts(texts, path)
            yield pa.record_batch([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
