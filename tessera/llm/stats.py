"""Counts over words, lines and characters of texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm import arrays

U64 = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1] = True
_LETTERS[0x80:] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[ord("0") : ord("9") + 1] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;,"]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # continuation bytes are not code points of their own
_LINE = np.zeros(256, bool)
_LINE[ord("\n")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "letter_share", "digit_share", "upper_share", "stop_share", "lone_sign_share", "log_line_words", "ended_lines", "long_word_share")


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which of keys occur twice or more."""
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    out = np.zeros(len(keys), bool)
    out[by[1:]] |= same
    out[by[:-1]] |= same
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Which of keys is the first of its value, in some fixed order."""
    by = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    out = np.zeros(len(keys), bool)
    out[by[new]] = True
    return out


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and a matrix of features (texts x FEATURES)."""
    data, offsets = arrays.utf8(texts)
    counts = {k: [np.zeros(0, np.int64)] for k in BASE}
    rows = [np.zeros((0, len(FEATURES)))]
    for i, j in arrays.slices(offsets):
        got, features = _measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in BASE:
            counts[k].append(got[k])
        rows.append(features)
    return {k: np.concatenate(v) for k, v in counts.items()}, np.concatenate(rows)


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n = len(offsets) - 1
    s, e = arrays.words(data, offsets)
    row = arrays.row_of(s, offsets)
    each = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    salt = arrays.mix(np.arange(1, n + 1, dtype=np.uint64))  # keys differ by row, so equal keys are of one row
    sums = arrays.prefix(arrays.BYTE_VALUE[data])
    word = arrays.span_hash(sums, s, e)
    n_words = arrays.per_row(n, row)
    lead = np.concatenate([[0], np.cumsum(_LEAD[data], dtype=np.int64)])
    chars = lead[e] - lead[s]
    out = {"n_words": n_words, "word_chars": arrays.per_row(n, row, chars), "n_symbols": each(SYMBOL[data])}

    # words in 3-word windows found twice or more in the text
    own = np.zeros(len(word), bool)
    if len(word) >= 3:
        tri = arrays.mix(word[:-2]) + arrays.mix(word[1:-1] * U64(3) + U64(1)) + arrays.mix(word[2:] * U64(5) + U64(2))
        inside = np.flatnonzero(row[:-2] == row[2:])
        again = inside[repeats(arrays.mix(tri[inside]) ^ salt[row[inside]])]
        for k in range(3):
            own[again + k] = True
    out["n_repeat_words"] = arrays.per_row(n, row[own])

    # lines with a word; the first of equals is not a duplicate
    a, b = arrays.words(data, offsets, _LINE)
    seen = np.searchsorted(s, b) > np.searchsorted(s, a)
    a, b = a[seen], b[seen]
    line_row = arrays.row_of(a, offsets)
    line = arrays.span_hash(sums, a, b) ^ salt[line_row]
    n_lines = arrays.per_row(n, line_row)
    out["n_dup_lines"] = n_lines - arrays.per_row(n, line_row[distinct(line)])

    w, c = np.maximum(n_words, 1), np.maximum(each(_LEAD[data]), 1)
    lines = np.maximum(n_lines, 1)
    signs = np.concatenate([[0], np.cumsum(_LETTERS[data] | _DIGITS[data], dtype=np.int64)])
    lone = (signs[e] - signs[s]) == 0
    features = np.stack(
        [
            np.log1p(n_words),
            out["word_chars"] / w,
            out["n_symbols"] / c,
            out["n_dup_lines"] / lines,
            out["n_repeat_words"] / w,
            arrays.per_row(n, row[distinct(word ^ salt[row])]) / w,
            each(_LETTERS[data] & _LEAD[data]) / c,
            each(_DIGITS[data]) / c,
            each(_UPPER[data]) / c,
            each(_STOP[data]) / c,
            arrays.per_row(n, row[lone]) / w,
            np.log1p(n_words / lines),
            arrays.per_row(n, line_row[_STOP[data[b - 1]]]) / lines,
            arrays.per_row(n, row[chars > 20]) / w,
        ],
        axis=1,
    )
    return out, features
