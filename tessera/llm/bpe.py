"""Byte-pair merging with a heap and a linked list, and the words it works on.

`Bpe` reads a public tokenizer file (its path is a parameter). `Words` cuts
texts into the pieces that the two supported files use, vectorised over code
points, and keeps one entry for each distinct piece.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from tokenizers import normalizers, pre_tokenizers

from tessera.llm import arrays

#: Distinct pieces that a worker keeps between batches; the older half goes when it is full.
CACHE = 150_000
#: Code points handled at once.
CHUNK = 500_000

OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: np.ndarray | None = None
_values: np.ndarray | None = None
_later: frozenset[str] | None = None

# The Unicode White_Space code points.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of each code point, made once a process."""
    global _classes, _values
    if _classes is None:
        kinds = np.zeros(0x110000, np.uint8)
        for c in [*range(0xD800), *range(0xE000, 0x110000)]:
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                kinds[c] = LETTER
            elif kind == "N":
                kinds[c] = NUMBER
        # Letters and numbers of a later Unicode than this Python's: as the tokenizer library has them.
        later = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, np.flatnonzero(kinds == OTHER).tolist()))) if unicodedata.category(c) == "Cn"]
        cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        for c in later:
            own = cutter.pre_tokenize_str(f"a{c}1")
            kinds[ord(c)] = OTHER if len(own) != 2 else LETTER if own[1][1][1] - own[1][1][0] == 1 else NUMBER
        kinds[list(WHITE_SPACE)] = SPACE
        _classes, _values = kinds, arrays.mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
    return _classes, _values


def later() -> frozenset[str]:
    """Letters that are unassigned in this Python's Unicode version."""
    global _later
    if _later is None:
        _later = frozenset(c for c in map(chr, np.flatnonzero(tables()[0] == LETTER).tolist()) if unicodedata.category(c) == "Cn")
    return _later


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where visible in Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Merges of one tokenizer file. `encode(piece)` gives ids, `count(piece)` only how many."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), k)
            self.made.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = s

    def symbols(self, piece: bytes) -> list[int]:
        ids = [self.inner[b] for b in piece]
        if ids:
            ids[-1] = self.final[piece[-1]]
        return ids

    def merge(self, ids: list[int]) -> int:
        """Merge in place: the lowest rank first, the leftmost of equals. Ids that a merge took become -1. Returns the number of merges."""
        n, get, made, done = len(ids), self.rank.get, self.made, 0
        bits = 12 if n <= 4096 else 40  # rank and position in one small integer
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(map(get, zip(ids, ids[1:], strict=False))) if r is not None]
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & low
            j = after[i]
            if j >= n or get((ids[i], ids[j])) != top >> bits:
                continue
            ids[i] = new = made[top >> bits]
            ids[j] = -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((new, ids[k]))) is not None:
                    heappush(heap, r << bits | i)
            if i and (h := before[i]) >= 0 and (r := get((ids[h], new))) is not None:
                heappush(heap, r << bits | h)
        return done

    def count(self, piece: bytes) -> int:
        """Initial symbols minus merges."""
        return len(piece) - self.merge(self.symbols(piece))

    def encode(self, piece: bytes) -> list[int]:
        ids = self.symbols(piece)
        self.merge(ids)
        return [x for x in ids if x >= 0]


def lower(text: str) -> str:
    """Canonical composition, then lower case letter by letter (no rule for a final sigma)."""
    if not text.isascii():
        if not later().isdisjoint(text):  # letters that this Python does not know: as the tokenizer library has them
            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def cut(points: np.ndarray, offsets: np.ndarray, lead_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece. Runs of letters, of numbers and of other signs; 's 't 're 've 'm 'll 'd apart.

    lead_space: a single space joins the run behind it, and all white space is
    kept; else white space is dropped and each number sign is a piece.
    """
    n = len(points)
    kinds = tables()[0][points]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    edge[n] = False
    head = edge[:n].copy()
    head[0] = True
    head[1:] |= kinds[1:] != kinds[:-1]
    marks = head.copy()
    if not lead_space:
        marks |= kinds == NUMBER
    s = np.flatnonzero(head)
    e = np.append(s[1:], n)
    kind = kinds[s]
    follows = np.append(~edge[s[1:]], False)  # the next run is in the same row
    joined = np.zeros(len(s), bool)
    if lead_space:
        blank = kind == SPACE
        ahead = blank & follows
        last = points[e - 1] == 0x20
        marks[s[ahead & (e - s == 1)]] = False
        marks[e[ahead] - 1] = True
        joined[1:] = (ahead & last)[:-1]
        marks[s[joined]] = False
    # contractions: a lone apostrophe before a letter run
    lone = np.flatnonzero((kind == OTHER) & (e - s == 1) & follows & ~joined & (points[s] == 0x27))
    lone = lone[kind[lone + 1] == LETTER]
    if len(lone):
        a, size = s[lone + 1], (e - s)[lone + 1]
        one = points[a]
        two = np.where(size > 1, points[np.minimum(a + 1, n - 1)], 0)
        taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        taken[((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 2
        taken[(one == ord("l")) & (two == ord("l"))] = 2
        hit = taken > 0
        a, size, taken = a[hit], size[hit], taken[hit]
        marks[a] = False
        more = size > taken
        marks[a[more] + taken[more]] = True
    starts = np.flatnonzero(marks)
    ends = np.append(starts[1:], n)
    if not lead_space:
        keep = kinds[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


@dataclass
class Pieces:
    """The pieces of some texts. keys: hashes of the distinct ones, ascending; word(i): the i-th of them; which: by position in the texts, which of them; part: and which text."""

    keys: np.ndarray
    which: np.ndarray
    part: np.ndarray
    joined: str
    starts: np.ndarray
    ends: np.ndarray

    def word(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


def pieces(texts: list[str], lead_space: bool) -> Pieces:
    joined, none = "".join(texts), np.zeros(0, np.int64)
    if not joined:
        return Pieces(np.zeros(0, np.uint64), none, none, joined, none, none)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    full = np.concatenate([offsets[:-1][np.diff(offsets) > 0], offsets[-1:]])
    starts, ends = cut(points, full, lead_space)
    keys = arrays.span_hash(arrays.prefix(tables()[1][points]), starts, ends)
    keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return Pieces(keys, which, arrays.row_of(starts, offsets), joined, starts[at], ends[at])


class Words:
    """The distinct-word table of a worker: what `make(piece)` gave, by the piece's hash, each distinct piece once while it is kept."""

    def __init__(self, make: Callable[[str], object], lead_space: bool, size: int = CACHE):
        self.make, self.lead_space, self.size = make, lead_space, size
        self.new: dict[int, object] = {}
        self.old: dict[int, object] = {}

    def look(self, key: int, own: Pieces, i: int):
        """The entry of a piece that the newer half does not have."""
        if (x := self.old.get(key)) is None:
            x = self.make(own.word(i))
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = x
        return x

    def table(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """For some texts: the entries of their distinct pieces, and by position in the texts which entry and which text."""
        own = pieces(texts, self.lead_space)
        keys = own.keys.tolist()
        entries = list(map(self.new.get, keys))
        for i in [i for i, x in enumerate(entries) if x is None]:
            entries[i] = self.look(keys[i], own, i)
        return entries, own.which, own.part


def batches(texts: list[str], size: int = CHUNK):
    """Ranges [i, j) of about size code points; a text is never split."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if total and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)
