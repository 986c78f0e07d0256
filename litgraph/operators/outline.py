"""Outlines of documents and places of quotes on a page. A document is one row, so its text is read where it stands."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Headings without a number, and the shapes of the others.
NAMED = ("abstract", "introduction", "background", "related work", "method", "methods", "methodology", "experiments", "results", "discussion", "limitations", "conclusion", "conclusions", "acknowledgements", "acknowledgments", "references")
NUMBERED = re.compile(r"(\d{1,2}(?:\.\d{1,2}){0,2})\.?\s+[A-Z].{0,90}")
APPENDIX = re.compile(r"(?:appendix\b.{0,80}|[A-Z]\.?\s+[A-Z][^.]{2,80})", re.I)
CAPTION = re.compile(r"(?:table|figure|fig\.)\s*\d", re.I)
PAGE = re.compile(r"=== page (\d+) ===")
HYPHENS = "-‐‑"


def outline(text: str) -> list[tuple[str, int, int, int]]:
    """(title, level, page, place) of each heading. A number counts if it is the last one's sibling, first child or an ancestor's
    sibling (the first is 1); a name counts once; captions, sentences and appendices before any heading do not count."""
    out: list[tuple[str, int, int, int]] = []
    last: tuple[int, ...] | None = None
    page, place, seen = 1, 0, set()
    for raw in text.splitlines(keepends=True):
        line = raw.strip()
        here, place = place, place + len(raw)
        if m := PAGE.fullmatch(line):
            page = int(m[1])
            continue
        if not line or line.endswith(".") or CAPTION.match(line):
            continue
        if m := NUMBERED.fullmatch(line):
            number = tuple(map(int, m[1].split(".")))
            allowed = {(1,)} if last is None else {last[:i] + (last[i] + 1,) for i in range(len(last))} | {(*last, 1)}
            if number in allowed:
                last = number
                out.append((line, len(number), page, here))
        elif line.casefold() in NAMED and line.casefold() not in seen:
            seen.add(line.casefold())
            out.append((line, 1, page, here))
        elif out and line.casefold().startswith("appendix") and APPENDIX.fullmatch(line):
            out.append((line, 1, page, here))
    return out


def outlines(texts: DataFrame) -> DataFrame:
    """id, title, level, page, place of all texts (id, text)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *s) for i, t in b.itertuples(index=False) for s in outline(t or "")], columns=["id", "title", "level", "page", "place"])

    return texts.select("id", "text").mapInPandas(task, "id long, title string, level int, page int, place long")


def preferred(bookmarks: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int, int | None]]:
    """Bookmarks (title, level, page) where there are any, each with the place of its heading line on its page; else the outline."""
    if not bookmarks:
        return list(outline(text))
    lines, page, place = [], 1, 0
    for raw in text.splitlines(keepends=True):
        if m := PAGE.fullmatch(raw.strip()):
            page = int(m[1])
        else:
            plain = " ".join(raw.split()).casefold()
            lines.append((page, plain, re.sub(r"^\d+(?:\.\d+){0,2}\.?\s+", "", plain), place))
        place += len(raw)
    find = lambda title, on: next((at for p, a, b, at in lines if p == on and " ".join(title.split()).casefold() in (a, b)), None)
    return [(title, level, on, find(title, on)) for title, level, on in bookmarks]


def folded(items: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Items joined by blanks, NFKC and lower case, white space to one blank, a hyphen at a break dropped with it; and the item and
    place of each character (item -1 between items)."""
    raw = []
    for i, item in enumerate(items):
        raw += [(c, i, at) for at, ch in enumerate(item) for c in unicodedata.normalize("NFKC", ch).lower()]
        if i + 1 < len(items):
            raw.append((" ", -1, 0))
    chars, k = [], 0
    while k < len(raw):
        c, i, at = raw[k]
        if c in HYPHENS and k + 1 < len(raw) and raw[k + 1][0].isspace():
            k += 1
            while k < len(raw) and raw[k][0].isspace():
                k += 1
            continue
        if c.isspace():
            if not chars or chars[-1][0] != " ":
                chars.append((" ", i, at))
        else:
            chars.append((c, i, at))
        k += 1
    return "".join(c for c, _, _ in chars), [(i, at) for _, i, at in chars]


def highlight(items: list[str], quote: str) -> list[tuple[int, int, int]]:
    """(item, start, end) of each item's part of a quote's first place."""
    text, where = folded(items)
    wanted = folded([quote])[0].strip()
    start = text.find(wanted) if wanted else -1
    found: dict[int, tuple[int, int]] = {}
    for i, at in where[start : start + len(wanted)] if start >= 0 else []:
        if i >= 0:
            lo, hi = found.get(i, (at, at + 1))
            found[i] = (min(lo, at), max(hi, at + 1))
    return [(i, a, b) for i, (a, b) in sorted(found.items())]


def highlights(pairs: DataFrame) -> DataFrame:
    """doc_id, item_id, line, start, end: the lines of a text as items. pairs: doc_id, item_id, text, quote."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, q, *h) for d, q, t, s in b.itertuples(index=False) for h in highlight((t or "").split("\n"), s or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "line", "start", "end"])

    return pairs.select("doc_id", "item_id", "text", "quote").mapInPandas(task, "doc_id long, item_id long, line int, start long, end long")
