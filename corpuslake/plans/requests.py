"""What a caller may ask for, checked and brought to one form before any plan is made."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


class RequestError(ValueError):
    """The request breaks a rule."""


MOST_QUERIES, QUERY_CHARS, MOST_K, MOST_ADMIN_K = 12, 4096, 40, 200
MOST_PAGES, MOST_CHARS, MOST_IDS, MOST_NOTEBOOKS = 5000, 20_000_000, 1000, 2000


def distinct(values: Iterable[str | None]) -> list[str]:
    """Stripped, without blanks, the first of equals kept."""
    return list(dict.fromkeys(v.strip() for v in values if v and v.strip()))


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise RequestError(f"{name} must be {low}..{high}")
    return value


@dataclass
class Retrieve:
    question: str = ""
    queries: list[str] = field(default_factory=list)
    notebook: str | None = None
    notebooks: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    history: list[tuple[str, str]] = field(default_factory=list)
    k: int = 10

    def __post_init__(self) -> None:
        """Several notebooks go before a single one; the question is the first of several queries."""
        self.notebooks = distinct(self.notebooks) or distinct([self.notebook])
        self.sources = distinct(self.sources)
        if not self.notebooks and not self.sources:
            raise RequestError("a notebook or a source is needed")
        if len(self.queries) > MOST_QUERIES:
            raise RequestError(f"at most {MOST_QUERIES} queries")
        asked = distinct(q[:QUERY_CHARS] for q in distinct(self.queries))
        self.queries = distinct([self.question, *asked])[:MOST_QUERIES] if asked else []
        if not self.queries and not self.question.strip():
            raise RequestError("a question is needed")
        _within("k", self.k, 1, MOST_K)


@dataclass
class Trace:
    question: str
    notebook: str | None = None
    notebooks: list[str] = field(default_factory=list)
    source: str | None = None
    k: int = 20
    final_k: int | None = None
    rewrite: bool = False
    rerank: bool = False

    def __post_init__(self) -> None:
        """Here both ways to name notebooks add up, and none means the whole collection."""
        self.notebooks = distinct([*self.notebooks, self.notebook])
        _within("k", self.k, 1, MOST_ADMIN_K)


@dataclass
class IngestText:
    notebook: str
    source: str
    pages: list[tuple[int, str]]

    def __post_init__(self) -> None:
        self.notebook, self.source = self.notebook.strip(), self.source.strip()
        if not self.notebook or not self.source:
            raise RequestError("a notebook and a source are needed")
        _within("pages", len(self.pages), 1, MOST_PAGES)
        if any(p < 1 for p, _ in self.pages):
            raise RequestError("pages count from 1")
        if sum(len(t) for _, t in self.pages) > MOST_CHARS:
            raise RequestError(f"at most {MOST_CHARS} characters")
        if not any(t.strip() for _, t in self.pages):
            raise RequestError("all pages are blank")


def ids_to_delete(ids: Iterable[str]) -> list[str]:
    out = distinct(ids)
    _within("ids", len(out), 1, MOST_IDS)
    return out


def notebooks_to_move(ids: Iterable[str]) -> list[str]:
    out = distinct(ids)
    _within("notebooks", len(out), 1, MOST_NOTEBOOKS)
    return out
