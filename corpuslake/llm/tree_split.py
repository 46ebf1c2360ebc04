"""Oversized items cut at natural boundaries (problem 3).

A text is parsed into a tree: sections nested by the depth of their headings, blocks parted
by blank lines, lists nested by indentation, tables of rows, fenced code, and markup
elements that span lines, with what they hold. Below that a leaf is parted into lines,
sentences, words and at last single characters, when it has to be.

Sibling subtrees are merged bottom-up up to the limit; only a node that is itself oversized
is descended into, and what is left of it isn't merged with its neighbours. So no piece
runs over the boundary of an oversized section. Concatenating what each piece adds to the
piece before gives the text back, character for character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASHES = re.compile(r"(#{1,6})(?:[ \t]|$)")
_EQUALS = re.compile(r"(={1,6})[^=\n].*?\1\s*$")
_UNDERLINE = re.compile(r"(=|-)\1{2,}\s*$")
_ITEM = re.compile(r"([ \t]*)(?:[-+•·–▪◦]|[*#;:]+|\d{1,3}[.)]|[A-Za-z][.)])(?:[ \t]|$)")
_MARKS = re.compile(r"[*#;:]+")
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_OPEN = re.compile(r"[ \t]*<[A-Za-z]")
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*?)?(/?)>")
DEEPEST = 40  # deeper lists and elements are leaves, parted by lines
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# How a leaf is parted, coarse to fine; each matches what stays with the part before the cut.
_FINER = (re.compile("\n"), re.compile("[.!?؟۔…]+[”»’\"')\\]]*\\s+"), re.compile(r"\s+"))


@dataclass
class Node:
    """A stretch of the text; the children cover it without gaps. A node without children is parted by ``_FINER[fine:]``."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    fine: int = 0


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    cuts = [m.end() for m in re.compile("\n").finditer(text, start, end)]
    edges = [start, *cuts, *([end] if not cuts or cuts[-1] < end else [])]
    return list(zip(edges, edges[1:], strict=False))


def _heading(text: str, lines: list[tuple[int, int]], i: int) -> tuple[int, int]:
    """(depth, lines) of the heading that begins at line i; depth 0 if there is none."""
    line = text[slice(*lines[i])].rstrip()
    if m := _HASHES.match(line) or _EQUALS.match(line):
        return len(m.group(1)), 1
    if line and len(line) <= 80 and line[-1] not in ".!?" and i + 1 < len(lines) and not _ITEM.match(line):
        if m := _UNDERLINE.match(text[slice(*lines[i + 1])].rstrip()):
            return (1 if m.group(1) == "=" else 2), 2
    return 0, 0


def _elements(text: str, lines: list[tuple[int, int]]) -> dict[int, int]:
    """The last line of each element that opens at the beginning of a line and ends on a later one, by its first line."""
    opened: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for i, (a, b) in enumerate(lines):
        for t in _TAG.finditer(text, a, b):
            name = t.group(2).lower()
            if t.group(1):
                if opened.get(name) and (begin := opened[name].pop()) < i:
                    out[begin] = max(out.get(begin, 0), i)
            elif not t.group(3) and name not in _VOID:
                opened.setdefault(name, []).append(i)
    return {i: j for i, j in out.items() if _OPEN.match(text, *lines[i])}


def _depth(line: str) -> int:
    """How deep a list line is nested: by its indentation, or by the number of its marks as wikis count."""
    m = _ITEM.match(line)
    marks = _MARKS.match(line)
    return len(m.group(1).expandtabs(4)) if not marks else len(marks.group()) - 1


def _list(text: str, lines: list[tuple[int, int]], i: int, stop: int, level: int = 0) -> list[Node]:
    """The items of a list, each with the items below it; a line that is no item goes with the item before."""
    out: list[Node] = []
    while i < stop:
        own, j = _depth(text[slice(*lines[i])]), i + 1
        while j < stop and not (_ITEM.match(text, *lines[j]) and _depth(text[slice(*lines[j])]) <= own):
            j += 1
        first = i + 1
        while first < j and not _ITEM.match(text, *lines[first]):
            first += 1
        own_line = Node(lines[i][0], lines[first - 1][1])
        out.append(Node(lines[i][0], lines[j - 1][1], [own_line, *_list(text, lines, first, j, level + 1)] if level < DEEPEST else []) if first < j else own_line)
        i = j
    return out


def _blocks(text: str, lines: list[tuple[int, int]], elements: dict[int, int], i: int, stop: int, level: int = 0) -> list[Node]:
    """Blocks of some lines; the blank lines after a block belong to it."""
    out: list[Node] = []
    while i < stop:
        begin, children = i, []
        line = text[slice(*lines[i])]
        if m := _FENCE.match(line):
            i += 1
            while i < stop and not text[slice(*lines[i])].lstrip().startswith(m.group(1)):
                i += 1
            i = min(stop, i + 1)
        elif i < elements.get(i, i) < stop:
            last = elements[i]
            if level < DEEPEST:
                children = [Node(*lines[i]), *_blocks(text, lines, elements, i + 1, last, level + 1), Node(*lines[last])]
            i = last + 1
        elif _ITEM.match(line):
            while i < stop and text[slice(*lines[i])].strip() and not _FENCE.match(text, *lines[i]):
                i += 1
            children = _list(text, lines, begin, i)
        else:
            row = line.lstrip().startswith("|")
            while i < stop and (own := text[slice(*lines[i])]).strip() and (i == begin or not _FENCE.match(own) and not _ITEM.match(own) and own.lstrip().startswith("|") == row and not i < elements.get(i, i) < stop):
                i += 1
            i = max(i, begin + 1)
        while i < stop and not text[slice(*lines[i])].strip():
            i += 1
        end = lines[i - 1][1]
        if children and children[-1].end < end:
            children.append(Node(children[-1].end, end))
        out.append(Node(lines[begin][0], end, children if len(children) > 1 else children[0].children if children else []))
    return out


def parse(text: str) -> Node:
    """The tree of a text."""
    lines = _lines(text, 0, len(text)) if text else []
    elements = _elements(text, lines)
    heads, fence, skip = [], "", 0
    for i, (a, b) in enumerate(lines):
        if m := _FENCE.match(text, a, b):
            fence = "" if fence == m.group(1) else fence or m.group(1)
        if i >= skip and not fence:
            depth, n = _heading(text, lines, i)
            if depth:
                heads.append((i, depth, n))
                skip = i + n
    root = Node(0, len(text), _blocks(text, lines, elements, 0, heads[0][0] if heads else len(lines)))
    path: list[tuple[int, Node]] = [(0, root)]
    for k, (i, depth, n) in enumerate(heads):
        stop = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        while path[-1][0] >= depth:
            path.pop()
        own = _blocks(text, lines, elements, i + n, stop)
        # A heading goes with what stands under it.
        first = own[0] if own else None
        title = Node(lines[i][0], first.end if first and not first.children else lines[i + n - 1][1], [])
        section = Node(lines[i][0], lines[stop - 1][1], [title, *(own[1:] if first and not first.children else own)])
        path[-1][1].children.append(section)
        for _, above in path:
            above.end = max(above.end, section.end)
        path.append((depth, section))
    return root


def _parted(text: str, node: Node) -> list[Node]:
    """The children of a node; of a leaf, its parts by the coarsest boundary that it has."""
    if node.children:
        return node.children
    for fine in range(node.fine, len(_FINER)):
        cuts = [m.end() for m in _FINER[fine].finditer(text, node.start, node.end) if m.end() < node.end]
        if cuts:
            edges = [node.start, *cuts, node.end]
            return [Node(a, b, [], fine + 1) for a, b in zip(edges, edges[1:], strict=False)]
    return []


def cut_points(text: str, first: int, later: int) -> list[int]:
    """Ends of the pieces: the first adds at most ``first`` characters, each later one ``later``."""
    ends: list[int] = []
    stack = [parse(text)]
    while stack:  # what is still to be cut, in order of the text, the next on top
        node = stack.pop()
        room = lambda at: later if at else first
        if node.end - node.start <= room(node.start):
            ends.append(node.end)
        elif children := _parted(text, node):
            merged = [children[0]]
            for a, b in zip(children, children[1:], strict=False):
                one = Node(merged[-1].start, b.end)
                if max(a.end - a.start, b.end - b.start) <= later and one.end - one.start <= room(one.start):
                    merged[-1] = one
                else:
                    merged.append(b)
            stack += merged[::-1]
        else:
            ends += [*range(node.start + room(node.start), node.end, later), node.end]
    return ends


def split_text(text: str, limit: int = 2000, overlap: int = 150) -> list[tuple[str, int, int]]:
    """(piece, start, end) with start and end of what the piece adds; the piece also repeats ``overlap`` characters before it.

    A text within the limit is one piece, an empty text none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(text, 0, len(text))]
    ends = cut_points(text, limit, limit - overlap)
    return [(text[max(0, a - overlap) if a else 0 : b], a, b) for a, b in zip([0, *ends], ends, strict=False)]


def latest(chunks: DataFrame, key: str = "id", version: str = "seq") -> DataFrame:
    """The valid version of each key, the highest. Rows with a null key are left out; a null version is the lowest."""
    return chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.col(version), F.lit(-(1 << 63)))).alias(version))


def split_oversized(chunks: DataFrame, limit: int = 2000, overlap: int = 150) -> DataFrame:
    """(id, piece, content, page_start, page_end) for every id whose valid content exceeds the limit.

    Pages are shared out by position: a piece starts on the page where its added text
    starts, if the chunk's pages are taken as equally long, so they stay within the
    chunk's pages and never go back; null pages stay null. Rows with null content or a
    null id give nothing; of rows with one id and version the one with the greatest text counts. Only oversized rows reach Python, and only keys and versions are
    shuffled to find the valid ones.
    """
    big = chunks.where(F.length("content") > limit).select("id", F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), "content", "page_start", "page_end")
    rows = big.join(latest(chunks), ["id", "seq"]).groupBy("id").agg(F.max(F.struct("content", "page_start", "page_end")).alias("r")).select("id", "r.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, p, q in zip(b["id"], b["content"], b["page_start"], b["page_end"], strict=True):
                pieces = split_text(text, limit, overlap)
                known = p == p and q == q and p is not None and q is not None
                p, q = (int(min(p, q)), int(max(p, q))) if known else (0, 0)
                page = lambda at, n=len(text), p=p, q=q: min(q, p + at * (q - p + 1) // n)
                for i, (piece, start, end) in enumerate(pieces):
                    out.append((key, i, piece, page(start) if known else None, page(end - 1) if known else None))
            frame = pd.DataFrame(out, columns=["id", "piece", "content", "page_start", "page_end"])
            yield frame.astype({"page_start": "Int32", "page_end": "Int32"})

    return rows.select("id", "content", "page_start", "page_end").mapInPandas(run, "id string, piece int, content string, page_start int, page_end int")
