"""Documents to tables: markdown blocks, sections, chunks, tables, layout blocks.

Parsing is local to a document, so each operator is one map over Arrow batches
(or built-in functions where regular expressions suffice); nothing shuffles.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts whose rows a worker holds at once.
TEXTS = 256
PAGE = re.compile(r"<!--\s*Page\s+(\d+)\s*-->|^\{(\d+)\}-{3,}", re.M)
HEADING = re.compile(r"(#{1,6})\s+(.+)")
BOLD = re.compile(r"\*\*(.+?)\*\*$")
LIST = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
RULE = re.compile(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")
BOLD_LEVELS = ((re.compile(r"[IVXLC]+\.\s"), 2), (re.compile(r"[A-Z]\.\s"), 3), (re.compile(r"\d+\.\s"), 3))


@dataclass
class Markdown:
    """One block of a text."""

    kind: str
    text: str
    start: int
    level: int | None = None
    heading: str | None = None
    page: int | None = None
    section: str | None = None

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def page_marks(text: str) -> tuple[list[int], list[int]]:
    """Where pages begin, and their numbers; `{n}` marks count from 0."""
    found = [(m.end(), int(m[1]) if m[1] else int(m[2]) + 1) for m in PAGE.finditer(text)]
    return [a for a, _ in found], [n for _, n in found]


def page_at(marks: tuple[list[int], list[int]], offset: int) -> int | None:
    starts, numbers = marks
    if not starts:
        return None
    return numbers[max(0, bisect_right(starts, offset) - 1)]


def is_table(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) >= 2 and any(x.strip().startswith("|") and x.strip().endswith("|") for x in lines) and any("|" in x and RULE.match(x) for x in lines)


def classify(text: str) -> tuple[str, int | None, str | None]:
    """Kind, heading level, heading text of a segment."""
    first = text.split("\n", 1)[0]
    if not text.strip():
        return "empty", None, None
    if PAGE.search(text):
        return "page_marker", None, None
    if m := HEADING.match(first):
        return "heading", len(m[1]), m[2].strip()
    if (m := BOLD.match(first.strip())) and 3 <= len(own := m[1].strip()) <= 200 and "|" not in own and re.search(r"[^\d\s.,;:!?'\"()\-/]", own):
        letters = re.sub("[^A-Za-z]", "", own)
        level = next((n for p, n in BOLD_LEVELS if p.match(own)), 1 if letters and letters.isupper() else 2)
        return "heading", level, own
    if is_table(text):
        return "table", None, None
    if text.strip().startswith("```"):
        return "code", None, None
    return ("list" if LIST.match(first) else "paragraph"), None, None


def blocks(text: str) -> list[Markdown]:
    """Segments between blank lines, a code fence whole, with the section each lies in."""
    marks, out, at, held = page_marks(text), [], 0, None
    trail: list[tuple[int, str]] = []
    for segment in text.split("\n\n") if text else []:
        fences = len(re.findall(r"^```", segment, re.M))
        if held is not None:
            held.text += "\n\n" + segment
            if fences % 2:
                held = None
        else:
            kind, level, heading = classify(segment)
            if fences % 2:
                kind, level, heading = "code", None, None
            b = Markdown(kind, segment, at, level, heading, page_at(marks, at))
            if kind == "heading":
                trail = [x for x in trail if x[0] < level] + [(level, heading)]
            b.section = " > ".join(h for _, h in trail) or None
            out.append(b)
            held = b if fences % 2 else None
        at += len(segment) + 2
    return out


@dataclass
class Chunk:
    """A chunk and where it lies: `pieces` are the places in its text and in the source of the runs that it is made of; between them the source may have markers and blank lines."""

    text: str
    pieces: list[tuple[int, int]]
    kinds: list[str] = field(default_factory=list)
    heading: str | None = None
    level: int | None = None
    section: str | None = None
    atomic: bool = False
    page: int | None = None
    page_range: str | None = None
    overlap_previous: int = 0
    overlap_next: int = 0

    def source(self, place: int) -> int:
        """Where a character of the text is in the source."""
        at, origin = self.pieces[max(0, bisect_right(self.pieces, (place, len(self.text) + 2**62)) - 1)]
        return origin + place - at

    @property
    def start(self) -> int:
        return self.source(0)

    @property
    def end(self) -> int:
        return self.source(len(self.text) - 1) + 1 if self.text else self.start

    def add(self, text: str, pieces: list[tuple[int, int]]) -> None:
        """Join a text on, a blank line between."""
        if self.text:
            self.text += "\n\n"
        self.pieces += [(len(self.text) + at, origin) for at, origin in pieces]
        self.text += text

    def part(self, low: int, high: int) -> tuple[str, list[tuple[int, int]]]:
        inner = [(at - low, origin) for at, origin in self.pieces if low < at < high]
        return self.text[low:high], [(0, self.source(low)), *inner]


def split_point(text: str, most: int, back: int = 500) -> int:
    """The last sentence end, blank line, line end or blank at or before `most`, at most `back` characters before; else `most`."""
    low, window = max(0, most - back), text[: most + 1]
    for pattern in (r"[.?!](?=[ \n])", r"\n(?=\n)", r"\n", " "):
        ends = [m.end() for m in re.finditer(pattern, text[low : most + 2]) if low + m.start() < len(window)]
        if ends:
            return low + ends[-1] + (1 if pattern == r"\n(?=\n)" else 0)
    return most


def chunks(text: str, target: int = 2000, most: int = 8000, overlap: float = 0.1, least: int = 100) -> list[Chunk]:
    """Section-aware chunks: headings begin a chunk, large tables and code stand alone, prose is cut at sentence ends."""
    marks, out = page_marks(text), []
    now: Chunk | None = None
    heading = level = section = None

    def close() -> None:
        nonlocal now
        if now is not None and now.text.strip():
            out.append(now)
        now = None

    def fresh(kinds: list[str] = ()) -> Chunk:
        return Chunk("", [], list(kinds), heading, level, section)

    for b in blocks(text):
        if b.kind in ("empty", "page_marker"):
            continue
        section = b.section or section
        if b.kind == "heading":
            close()
            heading, level = b.heading, b.level
        alone = b.kind in ("table", "code") and len(b.text) >= target // 4
        if alone:
            close()
            # the runs between tags
            runs = [(0, 0)] if b.kind == "code" else [(0, 0), *((m.end(), m.end()) for m in re.finditer("<[^>]*>", b.text))]
            own = re.sub("<[^>]*>", "", b.text) if b.kind == "table" else b.text
            whole = Chunk(own, [(0, b.start)])
            if b.kind == "table":
                gone, whole.pieces = 0, []
                for (_, begin), nxt in zip(runs, [*re.finditer("<[^>]*>", b.text), None], strict=True):
                    whole.pieces.append((begin - gone, b.start + begin))
                    gone += len(nxt[0]) if nxt else 0
            pos = 0
            while pos < len(own):
                end = len(own)
                if end - pos > most:
                    end = own.rfind("\n", pos + 1, pos + most + 1)
                    end = end if end > pos else pos + most
                if own[pos:end].strip():
                    c = fresh([b.kind])
                    c.add(*whole.part(pos, end))
                    c.atomic = True
                    out.append(c)
                pos = end + (end < len(own) and own[end] == "\n")
            continue
        if now is None:
            now = fresh()
        now.add(b.text, [(0, b.start)])
        kind = "text" if b.kind == "paragraph" else b.kind
        if kind not in now.kinds:
            now.kinds.append(kind)
        while now is not None and len(now.text) > target:
            cut, kinds = split_point(now.text, target), now.kinds
            one, rest = now.part(0, cut), now.part(cut, len(now.text))
            now.text, now.pieces = one
            close()
            now = fresh(kinds)
            now.add(*rest)
    close()
    # a small chunk that is a heading only joins the next, the last one the one before
    merged: list[Chunk] = []
    for c in out:
        p = merged[-1] if merged else None
        if p is not None and p.kinds == ["heading"] and len(p.text) < least and not p.atomic:
            own, c.text, c.pieces = (c.text, c.pieces), p.text, p.pieces
            c.add(*own)
            c.kinds = p.kinds + [k for k in c.kinds if k not in p.kinds]
            merged[-1] = c
        else:
            merged.append(c)
    if len(merged) > 1 and merged[-1].kinds == ["heading"] and len(merged[-1].text) < least:
        tail = merged.pop()
        merged[-1].add(tail.text, tail.pieces)
    size = int(target * overlap)
    for a, b in zip(merged, merged[1:], strict=False):
        if not a.atomic and not b.atomic:
            a.overlap_next = b.overlap_previous = size
    for c in merged:
        c.page, last = page_at(marks, c.start), page_at(marks, max(c.start, c.end - 1))
        c.page_range = None if c.page is None or c.page == last else f"{c.page}-{last}"
    return merged


def mapped(docs: DataFrame, key: str, text: str, make: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """key and the rows that make(text) gives: one map over Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in columns.split(", ")]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), TEXTS):
                own = pdf.iloc[i : i + TEXTS]
                yield pd.DataFrame([(k, *r) for k, t in zip(own[key], own[text], strict=True) for r in make(t or "")], columns=names)

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, {columns}")


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    return mapped(docs, key, text, lambda t: [(i, b.kind, b.start, b.end, b.level, b.heading, b.page, b.section, b.text) for i, b in enumerate(blocks(t))], "block_index int, kind string, start_offset int, end_offset int, level int, heading string, page int, section_path string, text string")


def chunked(docs: DataFrame, key: str, text: str, target: int = 2000, most: int = 8000) -> DataFrame:
    make = lambda t: [(i, c.text, c.start, c.end, c.kinds, c.heading, c.level, c.section, c.atomic, c.page, c.page_range, c.overlap_previous, c.overlap_next) for i, c in enumerate(chunks(t, target, most))]
    return mapped(docs, key, text, make, "chunk_index int, text string, start_offset int, end_offset int, content_types array<string>, heading string, heading_level int, section_path string, is_atomic boolean, page_number int, page_range string, overlap_previous int, overlap_next int")


def section_tree(chunk_table: DataFrame, key: str) -> DataFrame:
    """Every section of a document, with its depth, chunks, first and last chunk: prefixes of section paths, aggregated."""
    parts = F.split("section_path", " > ")
    each = chunk_table.where(F.col("section_path").isNotNull()).select(key, "chunk_index", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("p"))
    return each.groupBy(key, F.array_join(F.slice("p", 1, F.col("depth")), " > ").alias("section"), "depth").agg(F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))


def outline(block_table: DataFrame, key: str) -> DataFrame:
    """The first occurrence of each heading, in order."""
    first = block_table.where("kind = 'heading'").groupBy(key, "heading").agg(F.min(F.struct("block_index", "level")).alias("m"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("m.block_index")).cast("long").alias("n"), "heading", F.col("m.level").alias("level"))


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, row, col, cell of every table row of a page, by built-in functions."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select(key, "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col", "td"))
    return cells.select(key, "row", "col", F.trim(F.regexp_replace(F.regexp_replace("td", "<[^>]*>", ""), r"\s+", " ")).alias("cell"))


def pipe_cells(text: Column) -> Column:
    """Rows of cells of a pipe table, without its rule."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & ~F.rlike(x, F.lit(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def table_grid(cells: DataFrame, key: str) -> DataFrame:
    """One text a table row, cells in order."""
    return cells.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), " | ").alias("line"), F.count("*").alias("n_cells"))


def dice(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def continuations(tables: DataFrame, key: str, order: str, page: str, headers: str, least: float = 0.8) -> DataFrame:
    """Does a table go on from the one before: at most a page later, with alike headers?"""
    own = Window.partitionBy(key).orderBy(order)
    return tables.withColumn("continues", F.coalesce((F.col(page) - F.lag(page).over(own) <= 1) & (dice(F.col(headers), F.lag(headers).over(own)) >= least), F.lit(False)))


def repeated_lines(lines: DataFrame, key: str, page: str, line: str) -> DataFrame:
    """Lines on more than half of a document's pages, and on two at least."""
    n = lines.groupBy(key).agg(F.count_distinct(page).alias("n_pages"))
    return lines.where(F.trim(line) != "").groupBy(key, F.lower(F.trim(line)).alias("line")).agg(F.count_distinct(page).alias("on_pages")).join(n, key).where((F.col("on_pages") >= 2) & (F.col("on_pages") > 0.5 * F.col("n_pages")))


def walk_blocks(tree: object, page: int | None = None) -> Iterator[tuple[dict, int | None]]:
    """Blocks of a layout tree with their page, parents before children; a page's number comes from its block or its place."""
    for i, x in enumerate(tree if isinstance(tree, list) else [tree]):
        if isinstance(x, dict):
            own = x.get("page", i + 1) if x.get("block_type") == "Page" else page
            yield x, own
            yield from walk_blocks(x.get("children") or x.get("blocks") or [], own)


def walk(tree: object, page: int | None = None, depth: int = 0) -> Iterator[dict]:
    """The same as rows of kind, page, depth, html and text."""
    if isinstance(tree, list):
        for x in tree:
            yield from walk(x, page, depth)
    elif isinstance(tree, dict):
        kind = tree.get("block_type", "")
        if kind == "Page":
            page = tree.get("page", (page or 0) + 1)
        yield {"kind": kind, "page": page, "depth": depth, "html": tree.get("html") or "", "text": block_text(tree)}
        for x in tree.get("children") or tree.get("blocks") or []:
            yield from walk(x, page, depth + 1)


def block_text(block: dict) -> str:
    if block.get("html"):
        return re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", block["html"])).strip()
    if block.get("text"):
        return block["text"]
    return " ".join(filter(None, map(block_text, block.get("children") or block.get("blocks") or [])))


def layout_blocks(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of a JSON layout tree of any depth."""

    def make(t: str) -> list[tuple]:
        try:
            tree = json.loads(t) if t else []
        except ValueError:
            return []
        return [(i, b["kind"], b["page"], b["depth"], b["text"]) for i, b in enumerate(walk(tree))]

    return mapped(docs, key, column, make, "block_index int, kind string, page int, depth int, text string")


def block_stats(block_table: DataFrame, key: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return block_table.groupBy(key).agg(F.count("*").alias("n_blocks"), n("heading").alias("n_headings"), n("table").alias("n_tables"), n("code").alias("n_code"), n("list").alias("n_lists"), F.sum(F.length("text")).alias("n_chars"))
