"""Text of scanned pages made continuous and readable (problem 1).

Pages are parsed once, into their words, the words that line ends may divide, and the pairs
of neighbouring lines at their edges; everything else works on these.

Lines: classifiers judge pairs of neighbouring lines. One tells a divided word from a true
hyphen. Another tells whether an edge line and its neighbour are running text: boosted
trees, fitted on pairs from inside pages and on edge lines that are certainly furniture
(those with a page number beside a title, and those on a good share of their source's pages). An edge
line that is repeated on two pages of its source, evened out and without its numbers, and
that on the whole doesn't run on is a running title. Printed page numbers stand alone or
beside a title.

Words: all words are counted over all pages. Correction candidates come from an inverted
join on the rarest q-grams of the evened-out words, over the whole word: forms that differ
by an edit at most always share one. Boosted trees rank the candidates by their
frequencies, the confusions needed and how well the letters follow each other, and alone
decide whether a word is misread. Which letter a sign inside a word stands for is learned
from the words that fit it but for one letter, beside a list of known confusions. Training
pairs are made from the corpus itself: confusions are put into all of its words
with the counts that certain misreadings, those with digits or signs inside a word, show
for their true words. A run of more than ``LONGEST`` letters is no word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.boost import Boosted, Logistic, fit_logistic, fit_trees, written
from corpuslake.session import cut_lineage

#: No longer a bound: the models are fitted on all compounds. Kept since a test names it.
FIT_COMPOUNDS = 5_000
#: Rows of a key and a few short values that may be sent to every task; beyond it they are met by a shuffle.
MOST_SENT = 500_000
Q, LONGEST, THRESHOLD, PAIR = 3, 60, 0.5, 16
#: What a scan may print for a letter, as far as known; the ranking weighs them by how often they occur.
CONFUSIONS = (("1", "l"), ("0", "o"), ("rn", "m"), ("c", "e"), ("†", "t"), ("!", "i"), ("|", "l"), ("5", "s"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("6", "b"), ("9", "g"), ("vv", "w"), ("8", "b"), ("$", "s"), ("€", "e"), ("@", "a"))
_SIGNS = "0-9!|†$€@"
_EVEN = {"1": "l", "0": "o", "†": "t", "!": "l", "|": "l", "i": "l", "5": "s", "6": "b", "9": "g", "8": "b", "$": "s", "€": "c", "@": "a", "e": "c", "m": "rn", "d": "cl", "u": "ll", "h": "ll", "w": "vv"}
_HARD = re.compile(f"(?:[^\\W\\d_][{_SIGNS}]+(?=[^\\W\\d_])|[^\\W\\d_][0-9|†$€@]+$|^[0-9|!†$€@]+[^\\W\\d_])")
_WORD = re.compile(f"[\\w{_SIGNS}\ue000]+(?:[-’'][\\w{_SIGNS}\ue000]+)*")
_BAD = re.compile("[ÃÂØÙ€‚„√�\x80-\x9f¢-ª¬-¶¸-º¼-¾]")
_MARKS = "-\xad¬‐‑"
_HYPHEN = re.compile(f"([^\\W\\d_]+)([{_MARKS}]) ?$")
_HEAD_WORD = re.compile("\\s*([^\\W\\d_]+)")
_NUMBER = re.compile(r"^(?:(?:page|seite|página|pag|pág|p|s|صفحة|ص|стр|с)\b\.?\s*)?[\W_]*([0-9٠-٩۰-۹lOoIi!|]{1,6}|[ivxlcdm1!|]{1,8})(?:\s*(?:/|of|von|de|sur)\s*[0-9٠-٩lOIi!|]{1,6})?[\W_]*$", re.I)
_DIGIT = re.compile("[0-9٠-٩۰-۹]")
_ENDED = re.compile("[.!?؟”»,;:،]\\s*$")


class Confusions:
    """What may be printed for what, with the forms in which a word and its misreadings coincide."""

    def __init__(self, learned: dict[str, list[str]] | None = None):
        learned = {sign: [x for x in letters if (sign, x) not in CONFUSIONS] for sign, letters in (learned or {}).items()}
        pairs = [*CONFUSIONS, *((sign, x) for sign, letters in sorted(learned.items()) for x in letters)]
        self.pairs = (*pairs, ("d", "cl"), ("m", "rn"))
        self.signs = {a: b for a, b in reversed(pairs) if len(a) == 1 and not a.isalpha()}
        self.table = str.maketrans(_EVEN | {sign: _EVEN.get(x[0], x[0]) for sign, x in learned.items() if x and sign not in _EVEN})
        printed: dict[str, list[str]] = {}
        for a, b in self.pairs:
            printed.setdefault(b, []).append(a)
        self.printed, self.parts = printed, sorted(printed, key=len, reverse=True)

    def even(self, word: str) -> str:
        """What looks alike becomes one, what may fall apart is spelled apart."""
        return word.lower().translate(self.table)

    def between(self, word: str, candidate: str) -> int:
        """The fewest confusions that print the candidate as the word; 9 if they can't."""
        w, c = word.lower(), candidate.lower()
        best = [[9] * (len(c) + 1) for _ in range(len(w) + 1)]
        best[0][0] = 0
        for i in range(len(w) + 1):
            for j in range(len(c) + 1):
                if best[i][j] >= 9:
                    continue
                if i < len(w) and j < len(c) and w[i] == c[j]:
                    best[i + 1][j + 1] = min(best[i + 1][j + 1], best[i][j])
                for t in self.parts:
                    if c.startswith(t, j):
                        for p in self.printed[t]:
                            if w.startswith(p, i):
                                best[i + len(p)][j + len(t)] = min(best[i + len(p)][j + len(t)], best[i][j] + 1)
        return best[-1][-1]

    def readings(self, word: str) -> list[tuple[str, int]]:
        """What a word may have been, with one confusion undone at one place, and each sign inside it undone."""
        w = word.lower()
        base = "".join(self.signs.get(c, c) for c in w) if any(c.isalpha() for c in w) else w
        out = [(base, sum(a != b for a, b in zip(base, w, strict=True)))] if base != w else []
        start = base if base != w else w
        for a, b in self.pairs:
            if a.isalpha():
                i = start.find(a)
                while i >= 0:
                    out.append((start[:i] + b + start[i + len(a) :], 1 + (base != w)))
                    i = start.find(a, i + 1)
        return out


_ROMAN = re.compile("(?=.)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def is_number(line: str) -> bool:
    """Whether a line is a printed page number alone, in digits or small Roman ones; a number or word that ends a sentence is none."""
    s = line.strip()
    m = _NUMBER.match(s) if len(s) <= 24 else None
    if not m or re.search(r"\w\.$", s) and not re.match(r"[\W_]*p", s, re.I):
        return False
    core = m.group(1)
    return bool(_DIGIT.search(core)) or bool(re.fullmatch("[lIO|!]{1,4}", core)) or core == core.lower() and bool(_ROMAN.fullmatch(re.sub("[1!|]", "i", core)))


@lru_cache(50_000)
def edge_parts(line: str) -> tuple[str, bool]:
    """(title, numbered): an edge line without the page number that may stand beside it."""
    line = line.strip()
    if "  " in line or "\t" in line:
        parts = [p for p in re.split(r"\s{2,}|\t", line) if p]
        for i in (0, -1):
            if len(parts) >= 2 and is_number(parts[i]):
                return " ".join(parts[1:] if i == 0 else parts[:-1]), True
    return ("", True) if is_number(line) else (line, False)


_KNOWN = Confusions()
_TITLE_WORD = re.compile(f"[\\w{_SIGNS}§]+")


@lru_cache(50_000)
def title_key(title: str) -> str:
    """The title without its numbers, evened out, so that chapters and misreadings of one title agree."""
    words = []
    for w in _TITLE_WORD.findall(title):
        if w.isalpha() and len(w) > 2:
            words.append(_KNOWN.even(w))
        else:
            digits = sum(c.isdigit() for c in w)
            words.append("#" if digits * 2 >= len(w) and digits or re.fullmatch("[lIO!|]{1,2}", w) else _KNOWN.even(w))
    return " ".join(words)


def parse(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n") if x.strip()]


def divisions(lines: list[str]) -> Iterator[tuple[int, re.Match, re.Match]]:
    """(line, what a mark ends it with, the word at the beginning of the next): every pair of lines that may divide a word."""
    for i in range(len(lines) - 1):
        if lines[i][-2:].rstrip(" ")[-1:] in _MARKS and (m := _HYPHEN.search(lines[i])) and (h := _HEAD_WORD.match(lines[i + 1])):
            yield i, m, h


def joined(lines: list[str], dividing) -> list[str]:
    """Lines with divided words made whole on the upper line."""
    out = list(lines)
    for i in range(len(out) - 1):
        for _, m, h in divisions(out[i : i + 2]):
            if dividing(m.group(1), m.group(2), h.group(1)):
                rest = out[i + 1][h.end(1) :]
                tail = re.match(r"\S*", rest).group()
                out[i] = out[i][: m.start(2)] + h.group(1) + tail
                out[i + 1] = rest[len(tail) :].lstrip()
    return [x for x in out if x]


def words(text: str) -> list[str]:
    """The words of a text in lower case; one that holds or touches the remains of a wrong decoding is left out."""
    if not _BAD.search(text):
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(_BAD.sub("\ue000", text)) if "\ue000" not in w]


class Letters:
    """How well letters follow each other: weights of trigrams with word edges, and of the two letters they begin with."""

    def __init__(self, tri: dict[str, float]):
        self.tri, self.bi = tri, Counter()
        for t, n in tri.items():
            self.bi[t[:2]] += n

    def score(self, word: str) -> float:
        p = "^^" + word.lower() + "$"
        return sum(math.log((self.tri.get(p[i : i + 3], 0) + 0.05) / (self.bi.get(p[i : i + 2], 0) + 4)) for i in range(len(p) - 2))


def features(word: str, candidate: str, n: float, m: float, total: float, letters: Letters, known: Confusions) -> list[float]:
    """What the ranking sees of a word and a candidate with their counts among all words."""
    gain = letters.score(candidate) - letters.score(word)
    return [math.log((m + 0.1) / (n + 0.1)), math.log(1e6 * (m + 0.1) / total), gain, gain / max(1, len(word)), float(min(known.between(word, candidate), 9)), float(bool(_HARD.search(word))), float(len(word)), float(m > 0)]


def _divide_features(left: str, mark: str, right: str, compound: bool, letters: Letters) -> list[float]:
    whole = letters.score(left + right) - letters.score(left) - letters.score(right)
    return [float(mark != "-"), whole, float(right[:1].islower() or not right[:1].isupper()), float(compound), float(len(left)), float(len(right))]


def line_pair(upper: str, lower: str, bottom: bool, width: int) -> list[float]:
    """What a classifier sees of two neighbouring lines, one of which may be furniture: the lower one at the bottom of a page, else the upper one."""
    own, other = (lower, upper) if bottom else (upper, lower)
    own_words = own.split()
    initial = sum(w[:1].isupper() for w in own_words) / max(1, len(own_words))
    return [
        float(bottom), float(bool(_ENDED.search(own))), float(bool(_ENDED.search(upper))), float(lower.lstrip()[:1].islower()), len(own) / width, len(upper) / width, float(own[:4] == "    "),
        float(edge_parts(own)[1]), initial, float(len(own_words)), float(own.lstrip()[:1].islower()), float(own.isupper()), float(edge_parts(other)[1]), float(lower[:4] == "    "), float(own.lower() != own.upper()), len(lower) / width,
    ]


def _pairs(rows: pd.DataFrame) -> np.ndarray:
    """The figures of pairs of lines (mark, rest: upper and lower line; at: below 0 for the bottom of a page; n: its width)."""
    return np.array([line_pair(u, v, at < 0, n) for u, v, at, n in zip(rows["mark"], rows["rest"], rows["at"], rows["n"], strict=True)], float).reshape(len(rows), PAIR)


class Models:
    """The letter model, the ranking of corrections and the hyphen classifier, fitted on all words."""

    def __init__(self, letters: Letters, total: float, known: Confusions, rank: Boosted | None, divide: Logistic | None):
        self.letters, self.total, self.known, self.rank, self.divide = letters, total, known, rank, divide

    def dividing(self, rows: list[tuple[str, str, str, bool]]) -> np.ndarray:
        """Which of (left, mark, right, compound) are divided words: what the corpus holds as a compound within lines isn't, of others the classifier decides."""
        f = np.array([_divide_features(*r, self.letters) for r in rows]).reshape(len(rows), 6)
        return (f[:, 3] == 0) & (self.divide.predict(f) >= 0.5 if self.divide else np.ones(len(rows), bool))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("extract_id").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\S")).select("extract_id", F.coalesce("source_id", F.lit("")).alias("source"), F.coalesce(F.col("page").cast("string"), F.concat(F.lit("x"), F.col("extract_id").cast("string"))).alias("page"), "text")


_PARSED = "kind string, extract_id bigint, source string, page string, at int, word string, mark string, rest string, n bigint, numbered boolean"
_SHAPE = re.compile(f"[{_SIGNS}dm]|rn|c|ii|li|vv")


def parsed(pages: DataFrame) -> DataFrame:
    """What one reading of all pages gives, by kind: ``word`` (a word and its count in a part of the pages), ``suspects`` (a page's distinct
    words that confusions could have made, a line each), ``division`` (a mark between two line parts), ``edge`` (the key of an edge line, the
    two lines of its pair and the page's width; ``at`` counts from 0 or back from -1) and ``inner`` (what the classifier sees of pairs of
    lines inside pages, and their number in a part of the pages)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        inner: Counter = Counter()
        shaped: dict[str, bool] = {}
        names = [c.split()[0] for c in _PARSED.split(", ")]
        kinds = {"kind": object, "source": object, "page": object, "word": object, "mark": object, "rest": object, "extract_id": "Int64", "at": "Int32", "n": "Int64", "numbered": "boolean"}
        frame = lambda rows: pd.DataFrame([r + (None,) * (len(names) - len(r)) for r in rows], columns=names).astype(kinds)
        for b in batches:
            out: list[tuple] = []
            for key, source, page, text in zip(b["extract_id"], b["source"], b["page"], b["text"], strict=True):
                lines = parse(text)
                cut = [(m.group(1), m.group(2), h.group(1)) for _, m, h in divisions(lines)]
                out += [("division", key, None, None, None, *c) for c in dict.fromkeys(cut)]
                found = words("\n".join(joined(lines, _always)) if cut else text)
                counts.update(found)
                own = []
                for w in set(found):
                    if (fits := shaped.get(w)) is None:
                        fits = bool(_SHAPE.search(w)) and not w.isdigit()
                        if len(shaped) < 500_000:
                            shaped[w] = fits
                    if fits:
                        own.append(w)
                if own:
                    out.append(("suspects", key, None, None, None, "\n".join(own)))
                out += _edges(key, source, page, lines)
                inner.update(_inner(key, lines))
            yield frame(out)
            if len(inner) > 200_000:
                yield frame([("inner", None, None, None, None, x, None, None, n) for x, n in inner.items()])
                inner = Counter()
            if len(counts) > 200_000:
                yield frame(_counted(counts))
                counts = Counter()
        yield frame(_counted(counts))
        yield frame([("inner", None, None, None, None, x, None, None, n) for x, n in inner.items()])

    return pages.mapInPandas(run, _PARSED)


def _always(left: str, mark: str, right: str) -> bool:
    return True


def _counted(counts: Counter) -> list[tuple]:
    return [("word", None, None, None, None, w, None, None, n) for w, n in counts.items() if len(w) <= LONGEST and any(map(str.isalpha, w))]


def _edges(key: int, source: str, page: str, lines: list[str]) -> list[tuple]:
    width, n, out, seen = max(map(len, lines)), len(lines), [], set()
    for at in (0, -1, 1, -2):
        i = at if at >= 0 else n + at
        if i in seen or not 0 <= i < n:
            continue
        seen.add(i)
        title, numbered = edge_parts(lines[i])
        # A second line counts only if one of the two has a page number.
        if at in (1, -2) and not numbered and not edge_parts(lines[0 if at == 1 else -1])[1]:
            continue
        upper, lower = (lines[i], lines[i + 1] if i + 1 < n else "") if at >= 0 else (lines[i - 1] if i else "", lines[i])
        out.append(("edge", key, source, page, at, title_key(title) if title else "", upper, lower, width, numbered))
    return out


def _inner(key: int, lines: list[str]) -> Iterator[str]:
    """All pairs of lines inside a page, two lines from its edges, seen in turn from either of their lines."""
    if len(lines) >= 8:
        width = max(map(len, lines))
        for i in range(2, len(lines) - 3):
            yield written(line_pair(lines[i], lines[i + 1], bool((key + i) % 2), width))


def learned_signs(lexicon: DataFrame, least: int = 3, share: float = 0.2) -> dict[str, list[str]]:
    """The letters that each sign stands for in words that another, more frequent word fits but for that one letter.

    A pair of a sign and a letter is taken if ``least`` words vote for it and these are
    ``share`` of the sign's votes. As many rows reach the driver as there are signs and letters.
    """
    # Each word with each of its places left open; those with a sign there ask, those of letters alone answer.
    sized = lexicon.where((F.length("word") >= 5) & (F.length("word") <= LONGEST))
    places = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.concat(F.substring("word", F.lit(1), i - 1), F.lit(" "), F.substring("word", i + 1, F.length("word"))).alias("open"), F.substring("word", i, F.lit(1)).alias("letter")))
    asked = sized.where(F.col("word").rlike(f"^\\p{{L}}+[{_SIGNS}]\\p{{L}}+$")).select("n", F.explode(F.filter(places, lambda p: ~p["letter"].rlike("\\p{L}"))).alias("p")).select("n", "p.open", F.col("p.letter").alias("sign"))
    known = sized.where(F.col("word").rlike("^\\p{L}+$") & (F.col("n") > 1)).select(F.col("n").alias("m"), F.explode(places).alias("p")).select("m", "p.open", "p.letter")
    votes = asked.join(known, "open").where("m >= 2 * n").groupBy("sign", "letter").agg(F.count("*").alias("votes")).collect()
    total: Counter = Counter()
    for r in votes:
        total[r["sign"]] += r["votes"]
    out: dict[str, list[str]] = {}
    for r in sorted(votes, key=lambda r: (r["sign"], -r["votes"], r["letter"])):
        if r["votes"] >= least and r["votes"] >= share * total[r["sign"]]:
            out.setdefault(r["sign"], []).append(r["letter"])
    return out


def _letters(sound: DataFrame) -> Letters:
    """The letter model of all words. As many rows reach the driver as there are trigrams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tri: Counter = Counter()
        for b in batches:
            for w, n in zip(b["word"], b["n"], strict=True):
                p, weight = "^^" + w.lower() + "$", round((1 + math.log(n)) * (1 << 20))
                for i in range(len(p) - 2):
                    tri[p[i : i + 3]] += weight
        yield pd.DataFrame({"tri": pd.Series(list(tri), dtype=object), "n": pd.Series(list(tri.values()), dtype="int64")})

    found = sound.mapInPandas(run, "tri string, n bigint").groupBy("tri").agg(F.sum("n").alias("n")).collect()
    return Letters({r["tri"]: r["n"] / (1 << 20) for r in found})


def _ratios(lexicon: DataFrame, known: Confusions) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, share): how often all certain misreadings occur beside their true words, in steps of a sixteenth power of 2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, n) for w, n in zip(b["word"], b["n"], strict=True) for c, _ in known.readings(w)[:1]]
            yield pd.DataFrame({"word": pd.Series([r[0] for r in rows], dtype=object), "k": pd.Series([r[1] for r in rows], dtype="int64")})

    bent = lexicon.where(F.col("word").rlike(f"\\p{{L}}[{_SIGNS}]\\p{{L}}")).mapInPandas(run, "word string, k bigint")
    steps = bent.join(lexicon.where((F.col("n") >= 20) & F.col("word").rlike("^\\p{L}+$")), "word").groupBy(F.round(F.log2(F.col("k") / F.col("n")) * 16).alias("step")).count().orderBy("step").collect()
    if not steps:
        return np.array([0.01]), np.array([1.0])
    n = np.array([r["count"] for r in steps], float)
    return 2.0 ** (np.array([r["step"] for r in steps]) / 16), n / n.sum()


def _ranked_examples(lexicon: DataFrame, sound: DataFrame, letters: Letters, total: float, known: Confusions) -> DataFrame:
    """(x, y, n): confusions put into all words, and what the words themselves could have been."""
    ratios, shares = _ratios(lexicon, known)

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(form=[known.even(w) for w in b["word"]])

    rows = sound.mapInPandas(forms, "word string, n bigint, form string")
    # What may be a misreading itself is no example of either kind.
    rows = rows.join(rows.groupBy("form").agg(F.max("n").alias("most")), "form").where("most < 4 * n").select("word", "n")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["printed", "k", "word", "m", "own", "y"]
        for b in batches:
            out = []
            for w, count in zip(b["word"], b["n"], strict=True):
                rng = np.random.default_rng(zlib.crc32(w.encode()))
                for a, t in known.pairs:
                    places = [i for i in range(len(w)) if w.startswith(t, i)]
                    if places and rng.random() < 0.35:
                        i = int(rng.choice(places))
                        wrong = w[:i] + a + w[i + len(t) :]
                        n = max(1, round(count * float(rng.choice(ratios, p=shares)) * 0.3))
                        out.append((wrong, n, w, count if rng.random() < 0.75 else 0, None, 1.0))  # the true word may be unknown
                        # Candidates that aren't the true word; where a sign makes the word certain to be wrong, they still are better than none.
                        out += [(wrong, n, c, None, None, 0.0) for c, _ in known.readings(wrong)[:3] if c != w and not _HARD.search(wrong)]
                for c, _ in known.readings(w):
                    out.append((w, count, c, None, count, 0.0))
                    if rng.random() < 0.5:  # as if the word were rare
                        out.append((w, 1, c, 0, None, 0.0))
            yield pd.DataFrame(out, columns=names).astype({"printed": object, "word": object, "k": "int64", "m": "Int64", "own": "Int64", "y": "float64"})

    # A candidate's count is that of the lexicon, unless it is set, or is so high that the word may be its misreading.
    pairs = rows.mapInPandas(made, "printed string, k bigint, word string, m bigint, own bigint, y double").join(sound.withColumnRenamed("n", "found"), "word", "left")
    m = F.coalesce("m", F.when(F.col("own").isNull() | (F.col("found") < 4 * F.col("own")), F.col("found")), F.lit(0))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [written(features(w, c, float(n), float(k), total, letters, known)) for w, c, n, k in zip(b["printed"], b["word"], b["k"], b["m"], strict=True)]
            yield pd.DataFrame({"x": pd.Series(x, dtype=object), "y": b["y"], "n": 1})

    return pairs.select("printed", "word", "k", m.alias("m"), "y").mapInPandas(seen, "x string, y double, n bigint")


def _divided_examples(lexicon: DataFrame, sound: DataFrame, letters: Letters) -> DataFrame:
    """(x, y, n): all words cut at some place, against all compounds and each word beside another, which together weigh a fifth as much."""
    size = max(1, sound.count())
    order = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(max(1, size // 1000)))).orderBy(F.xxhash64("word"), "word")
    plain = sound.select("word", F.lead("word").over(order).alias("other"))
    compounds = lexicon.where(F.col("word").rlike("^\\p{L}+-\\p{L}+$") & (F.col("n") >= 2)).select("word", F.lit(None).cast("string").alias("other"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, other in zip(b["word"], b["other"], strict=True):
                if "-" in w:
                    out.append((written(_divide_features(w.split("-")[0], "-", w.split("-")[1], True, letters)), 0.0, 2))
                    continue
                if len(w) > 4:
                    i = 2 + zlib.crc32(w.encode()) % (len(w) - 3)
                    out += [(written(_divide_features(w[:i], mark, w[i:], False, letters)), 1.0, 5) for mark in ("-", "¬")]
                if other is not None:
                    out.append((written(_divide_features(w, "-", other, False, letters)), 0.0, 2))
            yield pd.DataFrame(out, columns=["x", "y", "n"]).astype({"x": object, "y": "float64", "n": "int64"})

    return plain.unionByName(compounds).mapInPandas(run, "x string, y double, n bigint")


def fit(lexicon: DataFrame) -> Models:
    """The models, from all words of the lexicon."""
    total = float(lexicon.agg(F.sum("n")).first()[0] or 1)
    sound = lexicon.where(F.col("word").rlike("^\\p{L}+$") & (F.length("word") > 2) & (F.length("word") <= LONGEST))
    known, letters = Confusions(learned_signs(lexicon)), _letters(sound)
    rank = fit_trees(_ranked_examples(lexicon, sound, letters, total, known))
    return Models(letters, total, known, rank, fit_logistic(_divided_examples(lexicon, sound, letters)))


def _rarest(forms: DataFrame) -> DataFrame:
    """(form, grams): the ``Q + 1`` rarest of each form's q-grams, rarest first, over the whole word with its ends marked.

    One edit spoils at most Q of a form's grams, so of two forms with one edit between them
    both hold one of the other's Q + 1 rarest. A form of three letters or less has them all.
    """
    padded = F.concat(F.lit("^"), F.col("form"), F.lit("$"))
    grams = forms.select("form", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("form") + 3 - Q), lambda i: F.substring(padded, i, F.lit(Q))))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rows = grams.join(counts, "gram").groupBy("form").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    return rows.select("form", F.transform(F.slice("g", 1, Q + 1), lambda g: g["gram"]).alias("grams"))


def misread_words(lexicon: DataFrame, models: Models, threshold: float = THRESHOLD) -> DataFrame:
    """(word, correction): words that aren't what was printed, with the best candidate.

    Words and candidates meet by the q-grams of their evened-out forms, which are equal or,
    for a word with a sign inside, one edit apart. Every word of a met form that is more
    frequent is a candidate; a word that meets none is tried with its signs or one
    confusion undone. The ranking decides, also for words with signs inside.
    """
    known = models.known

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(form=[known.even(w) for w in b["word"]])

    rows = cut_lineage(lexicon.where(F.col("word").rlike(f"^[\\p{{L}}{_SIGNS}]+$") & (F.length("word") > 2) & ~F.col("word").rlike("^[0-9lo!|]+$")).mapInPandas(forms, "word string, n bigint, form string"))
    heads = rows.where(F.col("word").rlike("^\\p{L}+$") & (F.col("n") > 1)).select(F.col("form").alias("other"), F.col("word").alias("head"), F.col("n").alias("m"))
    grams = cut_lineage(_rarest(rows.select("form").distinct()))
    asking = rows.groupBy("form").agg(F.max(F.col("word").rlike(f"[{_SIGNS}]")).alias("sign"), F.min("n").alias("least"))
    # A form that must be met exactly is looked up by its rarest gram alone.
    left = grams.join(asking, "form").select("form", "sign", "least", F.explode(F.when(F.col("sign"), F.col("grams")).otherwise(F.slice("grams", 1, 1))).alias("gram"))
    right = grams.join(heads.groupBy(F.col("other").alias("form")).agg(F.max("m").alias("most")), "form").select(F.col("form").alias("other"), "most", F.explode("grams").alias("gram"))
    met = left.join(right, "gram").where((F.col("most") >= 2 * F.col("least")) & (F.abs(F.length("form") - F.length("other")) <= 1))
    met = met.where((F.col("form") == F.col("other")) | F.col("sign") & (F.levenshtein("form", "other", 1) == 1)).select("form", "other").distinct()
    pairs = met.join(rows, "form").where((F.col("form") == F.col("other")) | F.col("word").rlike(f"[{_SIGNS}]")).join(heads, "other").where((F.col("head") != F.col("word")) & (F.col("m") >= 2 * F.col("n")))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = np.array([known.between(w, c) < 9 for w, c in zip(b["word"], b["head"], strict=True)], bool)
            hard = np.array([bool(_HARD.search(w)) for w in b["word"]], bool)
            yield b.assign(reach=near)[near | hard]

    pairs = cut_lineage(pairs.select("word", "n", "head", "m").mapInPandas(reached, "word string, n bigint, head string, m bigint, reach boolean"))
    alone = rows.join(pairs.select("word").distinct(), "word", "left_anti").select("word", "n", F.lit(None).cast("string").alias("head"), F.lit(0).cast("bigint").alias("m"), F.lit(True).alias("reach"))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            x, at = [], []
            for word, n, head, m, reach in zip(b["word"], b["n"], b["head"], b["m"], b["reach"], strict=True):
                tries = [(head, m)] if head is not None else [(c, 0) for c, _ in known.readings(word)]
                if head is None and len(tries) > 1:
                    tries = sorted(tries, key=lambda t: -model.letters.score(t[0]))[:1]
                for c, k in tries:
                    x.append(features(word, c, n, k, model.total, model.letters, known))
                    at.append((word, c, reach))
            score = model.rank.predict(np.array(x)) if x and model.rank else np.array([float(f[5]) for f in x])
            frame = pd.DataFrame(at, columns=["word", "correction", "reach"]).assign(score=score)
            yield frame[score >= threshold] if len(frame) else frame.astype({"score": "float64", "reach": "bool"})

    ranked = pairs.unionByName(alone).mapInPandas(run, "word string, correction string, reach boolean, score double")
    return ranked.groupBy("word").agg(F.max_by("correction", F.struct("reach", "score", "correction")).alias("correction"))


def _meet(rows: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose right side, already written, is sent to every task if it has few rows, so that the left one isn't shuffled."""
    return rows.join(F.broadcast(few) if few.count() <= MOST_SENT else few, on, how)


def _flow_model(edges: DataFrame, inner: DataFrame, pages_of: DataFrame, certain: int = 4, share: float = 0.15) -> Boosted | None:
    """The line-pair classifier: whether two lines are running text. Fitted on all certain edge lines and all pairs inside pages, either kind weighing the same."""
    sizes = edges.select("source", "page").distinct().groupBy("source").agg(F.count("*").alias("size"))
    sure = cut_lineage(pages_of.join(sizes, "source").withColumn("sure", (F.col("pages") >= certain) & (F.col("pages") >= share * F.col("size"))))
    sure = _meet(edges.where("word <> ''"), sure, ["source", "word"]).where("numbered or sure")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": pd.Series([written(x) for x in _pairs(b).tolist()], dtype=object), "y": 0.0, "n": 1})

    no = sure.select("mark", "rest", "at", "n").mapInPandas(seen, "x string, y double, n bigint")
    return fit_trees(no.unionByName(inner.select(F.col("word").alias("x"), F.lit(1.0).alias("y"), "n")), 40, even=True)


def furniture(parts: DataFrame, least: int = 2) -> DataFrame:
    """(extract_id, at, title, numbered): edge lines that are running titles, page numbers or both; ``at`` counts from 0 or back from -1.

    Repeated extractions of a page count once. Without examples to fit the classifier on, a
    line that ends like a sentence is running text.
    """
    edges = parts.where("kind = 'edge'").select("extract_id", "source", "page", "at", "word", "numbered", "mark", "rest", "n")
    titled = edges.where(F.col("word").rlike("\\p{L}"))
    pages_of = titled.select("source", "word", "page").distinct().groupBy("source", "word").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    pages_of = cut_lineage(pages_of)
    model = _flow_model(edges, parts.where("kind = 'inner'"), pages_of)
    shared = parts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _pairs(b)
            flow = shared.value.predict(x) if shared.value else x[:, 1]
            yield b[["source", "word", "page"]].assign(flow=flow)

    judged = _meet(titled, pages_of, ["source", "word"]).select("source", "word", "page", "mark", "rest", "at", "n").mapInPandas(run, "source string, word string, page string, flow double")
    once = judged.groupBy("source", "word", "page").agg(F.max("flow").alias("flow"))
    titles = once.groupBy("source", "word").agg(F.avg("flow").alias("flow")).where("flow < 0.5").select("source", "word", F.lit(True).alias("title"))
    rows = _meet(edges.drop("mark", "rest", "n"), cut_lineage(titles), ["source", "word"], "left").withColumn("title", F.coalesce("title", F.lit(False)))
    # A number beside other words is a page number only if those are a title.
    rows = rows.withColumn("numbered", F.col("numbered") & ((F.col("word") == "") | F.col("title")))
    return rows.where("title or numbered").select("extract_id", "at", "title", "numbered")


def divided(parts: DataFrame, lexicon: DataFrame, models: Models) -> DataFrame:
    """(extract_id, left, mark, right): the divided words of every page. Pairs are judged once each, with what the whole lexicon says of them as compounds."""
    found = parts.where("kind = 'division'").select("extract_id", F.col("word").alias("left"), "mark", F.col("rest").alias("right"))
    pairs = found.select("left", "mark", "right").distinct().withColumn("word", F.lower(F.concat("left", F.lit("-"), "right")))
    pairs = pairs.join(lexicon.where("n >= 2 and word like '%-%'").select("word", F.lit(True).alias("compound")), "word", "left").select("left", "mark", "right", F.coalesce("compound", F.lit(False)).alias("compound"))
    shared = parts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["left", "mark", "right"]][shared.value.dividing(list(b.itertuples(index=False, name=None)))]

    return _meet(found, cut_lineage(pairs.mapInPandas(run, "left string, mark string, right string")), ["left", "mark", "right"])


def _prepare(pages: DataFrame) -> tuple[DataFrame, DataFrame, Models, DataFrame]:
    """(what the pages were parsed into, the lexicon, the models, the misread words)."""
    parts = cut_lineage(parsed(_pages(pages)))
    lexicon = cut_lineage(parts.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n")))
    models = fit(lexicon)
    return parts, lexicon, models, cut_lineage(misread_words(lexicon, models))


def _wrong_on_pages(parts: DataFrame, lexicon: DataFrame, wrong: DataFrame, often: float = 1e-4) -> DataFrame:
    """(extract_id, word, correction), also for the parts of hyphenated words.

    Where the misread words are too many to be sent to all tasks, the most frequent words,
    which are fewer than ``1 / often`` and would be hot keys of the join, are taken out
    before it, unless they are misread.
    """
    whole = parts.where("kind = 'suspects'").select("extract_id", F.explode(F.split("word", "\n")).alias("word"))
    pieces = whole.where(F.col("word").rlike("[-’']")).select("extract_id", F.explode(F.split("word", "[-’']")).alias("word"))
    total = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    found = whole.unionByName(pieces)
    if wrong.count() > MOST_SENT:
        hot = lexicon.where(F.col("n") > often * total).select("word").join(wrong, "word", "left_anti")
        found = found.join(F.broadcast(hot), "word", "left_anti")
    return _meet(found, wrong, "word").select("extract_id", "word", "correction").distinct()


def defects(pages: DataFrame) -> DataFrame:
    """(extract_id, defect): hyphen, misread, header, page_number, one row for each that a page's text shows.

    The recorded method isn't read. Null and blank pages show none. Every extraction
    counts by its own id.
    """
    parts, lexicon, models, wrong = _prepare(pages)
    hyphen = divided(parts, lexicon, models).select("extract_id", F.lit("hyphen").alias("defect"))
    misread = _wrong_on_pages(parts, lexicon, wrong).select("extract_id", F.lit("misread").alias("defect"))
    edges = cut_lineage(furniture(parts))
    header = edges.where("title").select("extract_id", F.lit("header").alias("defect"))
    number = edges.where("numbered").select("extract_id", F.lit("page_number").alias("defect"))
    return hyphen.unionByName(misread).unionByName(header).unionByName(number).distinct()


def repair(pages: DataFrame) -> DataFrame:
    """(extract_id, text): continuous paragraphs without the marks of the scan; null and blank pages give an empty text.

    A paragraph begins at an indented line, after an empty line, or after a line that ends a
    sentence well before the width of the page.
    """
    parts, lexicon, models, wrong = _prepare(pages)
    fixes = _wrong_on_pages(parts, lexicon, wrong).groupBy("extract_id").agg(F.sort_array(F.collect_set(F.struct("word", "correction"))).alias("fixes"))
    cuts = divided(parts, lexicon, models).groupBy("extract_id").agg(F.sort_array(F.collect_set(F.struct("left", "mark", "right"))).alias("cuts"))
    edges = furniture(parts).groupBy("extract_id").agg(F.sort_array(F.collect_set("at")).alias("drop"))
    joinable = pages.select("extract_id", "text").where("extract_id is not null")
    for found in (fixes, cuts, edges):
        joinable = joinable.join(found, "extract_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, fix, cut, drop in zip(b["text"], b["fixes"], b["cuts"], b["drop"], strict=True):
                known = {f["word"]: f["correction"] for f in fix} if fix is not None else {}
                parted = {(c["left"], c["mark"], c["right"]) for c in cut} if cut is not None else set()
                out.append(paragraphs(text, known, set(drop) if drop is not None else set(), lambda *c, parted=parted: c in parted))
            yield pd.DataFrame({"extract_id": b["extract_id"], "text": out})

    return joinable.mapInPandas(run, "extract_id bigint, text string")


def _like(correction: str, word: str) -> str:
    if word.isupper() and len(word) > 1:
        return correction.upper()
    return correction[:1].upper() + correction[1:] if word[:1].isupper() else correction


def paragraphs(text: str | None, fixes: dict[str, str], drop: set[int], dividing) -> str:
    if not text or not text.strip():
        return ""
    raw = text.split("\n")
    filled = [i for i, x in enumerate(raw) if x.strip()]
    gone = {filled[a] for a in drop if -len(filled) <= a < len(filled)}
    blocks: list[list[str]] = [[]]
    lines = [(i, x) for i, x in enumerate(raw) if i not in gone]
    width = max((len(x) for _, x in lines), default=0)
    for _, x in lines:
        if not x.strip() or x.startswith("    ") and blocks[-1]:
            blocks.append([])
        if x.strip():
            blocks[-1].append(x)
            if re.search("[.!?؟][”»]?\\s*$", x) and len(x.rstrip()) < 0.6 * width:
                blocks.append([])

    def one(m: re.Match) -> str:
        w = m.group()
        if (c := fixes.get(w.lower())) is not None:
            return _like(c, w)
        return re.sub("[^-’']+", lambda p: _like(fixes[p.group().lower()], p.group()) if p.group().lower() in fixes else p.group(), w) if re.search("[-’']", w) else w

    done = []
    for block in blocks:
        if block:
            whole = " ".join(x.strip() for x in joined(block, dividing))
            done.append(_WORD.sub(one, whole) if fixes else whole)
    return "\n\n".join(done)
