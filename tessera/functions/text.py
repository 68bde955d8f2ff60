"""Text functions: tokens, stems, folding, query language, snippets."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits, JVM side."""
    return F.regexp_extract_all(F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(text: str) -> Column:
    """Spaces plus one."""
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1


def strip_html(text: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def strip_line_numbers(text: str) -> Column:
    """Drop scanned line numbers: digits and two blanks or more at the start of a line."""
    return F.regexp_replace(text, r"(?m)^\d+\s{2,}", "")


def strip_bold(text: str) -> Column:
    return F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")


def normalize_search(text: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slug(text: str) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")


def valid_hash(value: str) -> Column:
    return F.rlike(F.col(value), F.lit("^sha256:[a-f0-9]{64}$"))


class Marks(dict):
    """For str.translate: None for combining characters, as they are looked up."""

    def __missing__(self, c: int) -> int | None:
        out = self[c] = None if unicodedata.combining(chr(c)) else c
        return out


_marks = Marks()


def fold(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFD", word).translate(_marks)


def by_ending(rules: dict[str, str]) -> dict[str, list[tuple[str, str]]]:
    """Suffixes and what takes their place, by their last two letters, the longest first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for suffix in sorted(rules, key=len, reverse=True):
        out.setdefault(suffix[-2:], []).append((suffix, rules[suffix]))
    return out


class Porter:
    """The Porter stemmer, as its paper defines it.

    Words of a corpus are mostly rare, so each is stemmed anew: the kinds of its
    letters are found once (those of its beginning stay as the end is cut) and
    only rules with its last two letters are tried.
    """

    KINDS = str.maketrans({c: "v" if c in "aeiou" else "c" for c in string.ascii_letters})

    @classmethod
    def kinds(cls, w: str) -> str:
        """v or c for each letter."""
        k = w.translate(cls.KINDS)
        at = w.find("y", 1)
        while at > 0:
            if k[at - 1] == "c":
                k = k[:at] + "v" + k[at + 1 :]
            at = w.find("y", at + 1)
        return k

    # Suffix rules of steps 2 to 4.
    TWO = by_ending(dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log"))
    THREE = by_ending(dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness=""))
    FOUR = by_ending(dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), ""))

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w[-1] == "s":
            if w.endswith(("sses", "ies")):
                w = w[:-2]
            elif w[-2] != "s":
                w = w[:-1]
        # k may be longer than w: a beginning's measure is its number of vc
        k, n = cls.kinds(w), len(w)
        cvc = lambda n: n > 2 and k[n - 3 : n] == "cvc" and w[n - 1] not in "wxy"
        if w.endswith("eed"):
            if k.find("vc", 0, n - 3) >= 0:
                w = w[:-1]
        elif (cut := 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0) and k.find("v", 0, n - cut) >= 0:
            w, n = w[:-cut], n - cut
            if w.endswith(("at", "bl", "iz")):
                w, k = w + "e", k[:n] + "v"
            elif n > 1 and w[-1] == w[-2] and k[n - 1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif k.count("vc", 0, n) == 1 and cvc(n):
                w, k = w + "e", k[:n] + "v"
        if w[-1] == "y" and k.find("v", 0, len(w) - 1) >= 0:
            w, k = w[:-1] + "i", k[: len(w) - 1] + "v"
        for rules in (cls.TWO, cls.THREE):
            for suffix, to in rules.get(w[-2:], ()):
                if w.endswith(suffix):
                    if k.find("vc", 0, len(w) - len(suffix)) >= 0:
                        w = w[: -len(suffix)] + to
                        k = cls.kinds(w)
                    break
        for suffix, _ in cls.FOUR.get(w[-2:], ()):
            if w.endswith(suffix):
                n = len(w) - len(suffix)
                if k.count("vc", 0, n) > 1 and (suffix != "ion" or w[n - 1] in "st"):
                    w = w[:n]
                break
        if w[-1] == "e":
            n = len(w) - 1
            m = k.count("vc", 0, n)
            if m > 1 or (m == 1 and not cvc(n)):
                w = w[:-1]
        if w.endswith("ll") and k.count("vc", 0, len(w)) > 1:
            w = w[:-1]
        return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(text: pd.Series) -> pd.Series:
    """Folded, lower-case, stemmed tokens; each distinct word is stemmed once a batch."""
    seen: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in seen:
            seen[w] = Porter.stem(fold(w))
        return seen[w]

    return text.map(lambda t: [one(w) for w in re.findall(r"[^\W_]+", (t or "").lower())])


def stem_word(word: str) -> str:
    """What the index keeps of one word."""
    return Porter.stem(fold(word.lower()))


def parse_query(query: str, word: Callable[[str], str] = str.lower) -> list[list[tuple[str, list[str]]]]:
    """A boolean query as OR of ANDs: a list of alternatives, each a list of (sign, tokens); sign is '' or 'NOT', several tokens are a phrase.

    Operators at the ends or repeated are dropped, words side by side mean AND,
    a hyphen separates words, `word` gives the form that tokens have. A query
    without words is an error.
    """
    parts = re.findall(r'"[^"]*"|\S+', query)
    items: list[str | tuple[str, ...]] = []
    for p in parts:
        if p in ("AND", "OR", "NOT"):
            items.append(p)
        else:
            own = re.findall(r"[^\W_]+", p.lower())
            if p.startswith('"'):
                items += [tuple(map(word, own))] if own else []
            else:
                items += [(word(w),) for w in own]
    out: list[list[tuple[str, list[str]]]] = [[]]
    sign = ""
    pending_or = False
    for x in items:
        if x == "OR":
            pending_or = bool(out[-1])
        elif x == "AND":
            pass
        elif x == "NOT":
            sign = "NOT"
        else:
            if pending_or:
                out.append([])
                pending_or = False
            out[-1].append((sign, list(x)))
            sign = ""
    out = [a for a in out if any(s == "" for s, _ in a)]
    if not out:
        raise ValueError("the query has no words")
    return out


def query_terms(parsed: list[list[tuple[str, list[str]]]]) -> list[str]:
    return sorted({w for a in parsed for s, own in a if not s for w in own})


def matches(parsed: list[list[tuple[str, list[str]]]], own: Column) -> Column:
    """Does an array of tokens satisfy the query?"""

    def has(words: list[str]) -> Column:
        if len(words) == 1:
            return F.array_contains(own, words[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))

    any_of = None
    for a in parsed:
        every = None
        for sign, words in a:
            c = ~has(words) if sign else has(words)
            every = c if every is None else every & c
        any_of = every if any_of is None else any_of | every
    return any_of


def snippet(terms: list[str], size: int = 32, before: str = "<mark>", after: str = "</mark>"):
    """A pandas UDF: the first window of `size` tokens with most hits (words with the stem of a term), hits marked, cut ends shown as '...'."""
    wanted = set(map(stem_word, terms))

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        seen: dict[str, bool] = {}

        def hits(w: str) -> bool:
            if w not in seen:
                seen[w] = stem_word(w) in wanted
            return seen[w]

        def one(t: str | None) -> str:
            found = list(re.finditer(r"[^\W_]+", t or ""))
            if not found:
                return ""
            hit = [hits(m.group()) for m in found]
            total = [0, *accumulate(hit)]
            best = max(range(max(1, len(found) - size + 1)), key=lambda i: (total[min(i + size, len(hit))] - total[i], -i))
            last = min(best + size, len(found))
            out, at = ["..." if best else ""], found[best].start() if best else 0
            for m, h in zip(found[best:last], hit[best:last], strict=True):
                out += [t[at : m.start()], f"{before}{m.group()}{after}" if h else m.group()]
                at = m.end()
            return "".join(out) + (t[at:] if last == len(found) else "...")

        return text.map(one)

    return run
