"""Text quality of documents from the kind of their lines (problem 6).

Every line gets a few small figures (its mark, its end, number of words, cell separators,
share of digits, of odd symbols, of unpronounceable words and of common words). A hidden
Markov model with the states prose, list, table and junk labels the lines of a document
together; the label shares by characters tell prose from the rest. The model is fitted by
Viterbi training on at most ``SAMPLE`` documents, starting from lines whose kind is plain.
Common words are counted over all documents, those of each script by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "list", "table", "junk")
SAMPLE, COMMON_SHARE, ROUNDS = 3000, 0.0025, 4
#: Values of each figure of a line.
SIZES = (3, 3, 6, 5, 4, 4, 3, 4)
_MARK = re.compile(r"\s*(?:[-*•·–▪◦‣○●■]|\(?\d{1,3}[.)]|\d{1,2}(?:\.\d{1,2})+\.?|\(?[a-zA-Zа-яء-ي][.)]|\(?[ivx]{1,5}[.)])\s+\S")
_DIALOGUE = re.compile(r"\s*[—―]\s*\S")
_CELLS = re.compile(r"\S(?: {3,}|\t)\S|\S *\| *\S.*\S *\| *\S|^\s*\|.*\|\s*$|\S[;]\S[^;]*[;]\S|\S\s\|\s\S")
_FILL = re.compile(r"\.{4,}|…{2,}|_{3,}|(?:\. ){4,}|·{4,}")
_GLOSS = re.compile(r"^[^:.!?]{1,40}:\s+\S[^.!?]*$|^[^\d,.!?]{1,40}(?:,\s*\d{1,4}(?:[-–]\d{1,4})?)+$")
_END = re.compile("[.!?؟۔:”»\"][”»\"')\\]]*\\s*$")
_SOFT_END = re.compile("[,;،؛—-]\\s*$")
_ODD = re.compile("[/\\\\+=#@^~<>{}_*&%$\\[\\]\x00-\x08\x0b-\x1f\x7f\ue000-\uf8ff□▯■]")
_TOKEN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
# Words of three letters or more without a vowel, and words that mix letters and digits.
_UNSPOKEN = re.compile(r"(?<![^\W_])[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{3,}(?![^\W_])")
_BENT = re.compile(r"(?<![^\W_])(?:[A-Za-z]+\d|\d+[A-Za-z])[A-Za-z\d]*(?![^\W_])")
_WIDE, _NARROW = re.compile("[\uff01-\uff5e]"), {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
# Which script the blocks of 128 code points belong to, by its first block; -1 for signs, all others stand for themselves.
_SCRIPT = np.arange(0x110000 >> 7)
for _first, _last, _script in ((0x0, 0x27F, 0), (0x1E00, 0x1EFF, 0), (0x300, 0x3FF, 7), (0x1F00, 0x1FFF, 7), (0x400, 0x57F, 8), (0x600, 0x77F, 12), (0xFB00, 0xFDFF, 12), (0xFE80, 0xFEFF, 12), (0x2000, 0x2BFF, -1), (0xE000, 0xF8FF, -1), (0xFE00, 0xFE7F, -1), (0xFF80, 0xFFFF, -1), (0x3000, 0x9FFF, 96)):
    _SCRIPT[_first >> 7 : (_last >> 7) + 1] = _script
_PAGE_NUMBER = re.compile(r"^\W*(?:[^\W\d_]{1,8}\.?\s*)?\d{1,4}\W*(?:/\s*\d{1,4})?\W*$|^\W*[ivxlc]{1,7}\W*$", re.I)


def line_figures(line: str, common: frozenset[str]) -> tuple[tuple[int, ...], int, int, int, int]:
    """The bucketed figures of a line, and its numbers of words, word characters, odd symbols and common words."""
    words = _TOKEN.findall(line)
    n, size = len(words), sum(map(len, words))
    solid = max(1, len(line) - line.count(" "))
    known = sum(w in common for w in map(str.lower, words))
    odd = len(_ODD.findall(line))
    digits = len(_DIGIT.findall(line))
    bad = 0
    if n > 2 or size > 12:
        bad = len(_UNSPOKEN.findall(line)) + (len(_BENT.findall(line)) if digits else 0)
        if n >= 8 and (size < 2.2 * n or len({w[:1].lower() for w in words}) < 3):
            # Letters standing apart, or beginnings of one word over and over; a wrong decoding, whose
            # signs also part a word into letters, has neither between its blanks.
            apart = line.split()
            if sum(len(w) == 1 for w in apart) * 5 > 3 * len(apart) or len(line) < 8 * len(apart) and len({w[:1].lower() for w in apart}) == 1:
                bad, known = n, 0
        if size > 40 and n <= 2 and not line.strip().isalpha():
            bad = n
    mark = 1 if _MARK.match(line) else 2 if _DIALOGUE.match(line) else 0
    end = 1 if _END.search(line) else 2 if _SOFT_END.search(line) else 0
    length = 0 if n < 2 else 1 if n < 4 else 2 if n < 7 else 3 if n < 11 else 4 if n < 30 else 5
    # Plain tests first: few lines hold what the patterns look for.
    filled = ("...." in line or "…" in line or "___" in line or ". . " in line or "···" in line) and _FILL.search(line)
    celled = ("|" in line or "   " in line or "\t" in line or ";" in line) and _CELLS.search(line)
    cells = 2 if filled else 1 if celled else 3 if _GLOSS.match(line) else 4 if n and digits * 3 > size and n > 2 else 0
    share = digits / solid
    part = 1.0 if not n and solid > 6 and not digits else odd / solid
    figures = (
        mark, end, length, cells,
        0 if share < 0.05 else 1 if share < 0.2 else 2 if share < 0.5 else 3,
        0 if part < 0.02 else 1 if part < 0.1 else 2 if part < 0.2 else 3,
        0 if bad * 8 < n or not bad else 1 if bad * 5 < 2 * n else 2,
        0 if not known else 1 if known * 6 < n else 2 if known * 3 < n else 3,
    )
    return figures, n, size, odd, known


def plain_state(f: tuple[int, ...]) -> int:
    """The state of a line whose kind is plain, else -1; where the training starts."""
    mark, end, length, cells, digits, odd, bad, known = f
    if odd == 3 and cells not in (2,) or bad == 2:
        return 3
    if cells == 1:
        return 2
    if mark == 1 or cells in (2, 3) or length <= 1 and not end and not known and digits == 0:
        return 1
    if length >= 2 and (end == 1 and known or known >= 2) or length >= 3 and mark != 1 and not cells and odd < 2 and not bad and digits < 2:
        return 0
    return -1


class LineModel:
    def __init__(self) -> None:
        self.start = np.log(np.full(4, 0.25))
        self.move = np.log(np.full((4, 4), 0.05) + np.eye(4) * 0.8)
        self.emit = [np.log(np.full((4, n), 1 / n)) for n in SIZES]

    def scores(self, figures: np.ndarray) -> np.ndarray:
        out = np.zeros((len(figures), 4))
        for i, table in enumerate(self.emit):
            out += table[:, figures[:, i]].T
        return out

    def label(self, figures: np.ndarray, lengths: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        """Viterbi over many documents at once; ``lengths``: lines of each document, in order."""
        scores = self.scores(figures) if scores is None else scores
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(lengths) else np.zeros(0, int)
        sizes = lengths[order]
        back = np.zeros((len(figures), 4), np.int8)
        at = self.start + scores[first[sizes > 0]] if len(figures) else np.zeros((0, 4))
        best = np.zeros(len(figures), np.int8)
        for t in range(1, int(sizes.max()) + 1 if len(sizes) else 0):
            live = int((sizes > t).sum())
            ended = slice(live, len(at))
            best[first[: len(at)][ended] + t - 1] = at[ended].argmax(axis=1)
            if not live:
                break
            step = at[:live, :, None] + self.move[None]
            back[first[:live] + t] = step.argmax(axis=1)
            at = step.max(axis=1) + scores[first[:live] + t]
        for t in range(int(sizes.max()) - 1 if len(sizes) else 0, 0, -1):
            live = int((sizes > t).sum())
            i = first[:live] + t
            best[i - 1] = back[i, best[i]]
        return best

    def fit(self, figures: np.ndarray, lengths: np.ndarray) -> LineModel:
        """Counts of the plain lines first, then of the labels that the model itself gives; the plain ones keep their weight."""
        plain = np.array([plain_state(tuple(f)) for f in figures.tolist()], np.int64)
        self._count(figures, plain, lengths, None)
        for _ in range(ROUNDS):
            self._count(figures, plain, lengths, self.label(figures, lengths))
        return self

    def _count(self, figures: np.ndarray, plain: np.ndarray, lengths: np.ndarray, labels: np.ndarray | None) -> None:
        known = plain >= 0
        state = np.where(known, plain, labels if labels is not None else -1)
        ok = state >= 0
        weight = np.where(known, 1.0, np.where(state == 3, 0.0, 0.5))  # junk is learned from plain junk alone
        for i, n in enumerate(SIZES):
            c = np.full((4, n), 2.0)
            np.add.at(c, (state[ok], figures[ok, i]), weight[ok])
            self.emit[i] = np.log(c / c.sum(axis=1, keepdims=True))
        first = np.zeros(len(figures), bool)
        first[np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0].astype(int)] = True
        c = np.full(4, 5.0)
        np.add.at(c, state[first & ok], 1)
        self.start = np.log(c / c.sum())
        pair = np.flatnonzero(~first & ok & np.concatenate([[False], ok[:-1]]))
        c = np.full((4, 4), 3.0)
        np.add.at(c, (state[pair - 1], state[pair]), 1)
        self.move = np.log(c / c.sum(axis=1, keepdims=True))


def script(text: str) -> int:
    """The script that most letters of a text are of, as in ``_SCRIPT``; 0, Latin, without letters."""
    if text.isascii():
        return 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _SCRIPT[codes[codes > 64] >> 7]
    found = found[found >= 0]
    return int(np.bincount(found).argmax()) if len(found) else 0


def _narrow(text: str) -> str:
    return text.translate(_NARROW) if _WIDE.search(text) else text


def common_words(docs: DataFrame, text: str, least: float = COMMON_SHARE) -> frozenset[str]:
    """Words that make up at least ``least`` of the words of all texts mainly in their script, which bounds their number by 1 / least a script."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {}
        for b in batches:
            for t in map(_narrow, b["t"]):
                found = counts.setdefault(script(t), Counter())
                for line in t.lower().split("\n"):
                    some = line.split()
                    # Letters standing apart are no words, or every letter of a script would be a common one.
                    if len(line) >= 4 * len(some) or len(some) < 8 or sum(len(w) == 1 for w in some) * 5 <= 3 * len(some):
                        found.update(some)
            if sum(map(len, counts.values())) > 300_000:
                yield _word_rows(counts)
                counts = {}
        yield _word_rows(counts)

    counts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "script int, word string, n bigint").groupBy("script", "word").agg(F.sum("n").alias("n")).persist()
    totals = counts.groupBy("script").agg(F.sum("n").alias("total"))
    rows = counts.join(F.broadcast(totals), "script").where(F.col("n") >= F.greatest(F.lit(2.0), least * F.col("total"))).select("word").distinct().collect()
    counts.unpersist()
    return frozenset(r["word"] for r in rows if r["word"].isalpha())


def _word_rows(counts: dict[int, Counter]) -> pd.DataFrame:
    rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
    return pd.DataFrame(rows, columns=["script", "word", "n"]).astype({"script": "int32", "word": "object", "n": "int64"})


def _lines(texts: list[str | None], common: frozenset[str]):
    figures, lengths, chars, sums = [], [], [], []
    for text in texts:
        text = _narrow(text or "")
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        lengths.append(len(lines))
        words = size = odd = known = ended = 0
        for x in lines:
            f, n, s, o, k = line_figures(x, common)
            figures.append(f)
            chars.append(len(x) - x.count(" "))
            words, size, odd, known, ended = words + n, size + s, odd + o, known + k, ended + (f[1] == 1)
        sums.append((words, size, odd, known, ended))
    return np.array(figures, np.int64).reshape(-1, len(SIZES)), np.array(lengths, np.int64), np.array(chars, np.int64), sums


def fit_lines(docs: DataFrame, text: str, common: frozenset[str], sample: int = SAMPLE) -> LineModel:
    """The model from about ``sample`` documents, twice that at most, chosen by a hash of their text."""
    rows = docs.where(F.col(text).isNotNull())
    share = min(1.0, sample / max(1, docs.count()))
    picked = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) <= int(share * (1 << 20))).select(F.col(text).alias("t")).limit(2 * sample).toPandas().sort_values("t")
    figures, lengths, _, _ = _lines(list(picked["t"]), common)
    return LineModel().fit(figures, lengths) if len(figures) else LineModel()


def line_quality(docs: DataFrame, key: str = "row_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: key, figures of the text and the shares of its characters by label.

    Columns: words, mean_word_length, symbol_ratio, ended_lines (share of lines ending in
    punctuation), common_share, prose, list_part, table_part, junk, kind. kind is the
    label with most characters, ``number`` for a page with only a page number, ``blank``
    for a null or blank text (figures and shares are then 0). Repeated keys keep their rows.
    """
    common = common_words(docs, text)
    model = fit_lines(docs, text, common, sample)
    shared = docs.sparkSession.sparkContext.broadcast((common, model))
    schema = "key string, words int, mean_word_length double, symbol_ratio double, ended_lines double, common_share double, prose double, list_part double, table_part double, junk double, kind string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, model = shared.value
        for b in batches:
            texts = list(b["text"])
            figures, lengths, chars, sums = _lines(texts, common)
            labels = model.label(figures, lengths)
            doc = np.repeat(np.arange(len(texts)), lengths)
            by = np.bincount(doc * 4 + labels, chars, len(texts) * 4).reshape(-1, 4)
            total = np.maximum(by.sum(axis=1), 1)
            n = np.maximum(lengths, 1)
            w = np.array(sums, np.float64).reshape(-1, 5)
            count = np.maximum(w[:, 0], 1)
            kind = np.array(STATES, object)[by.argmax(axis=1)]
            kind[lengths == 0] = "blank"
            for i in np.flatnonzero(lengths == 1):
                if _PAGE_NUMBER.match(texts[i].strip()):
                    kind[i] = "number"
            values = [b["key"].to_numpy(), w[:, 0].astype(np.int32), w[:, 1] / count, w[:, 2] / total, w[:, 4] / n, w[:, 3] / count, *(by / total[:, None]).T, kind]
            yield pd.DataFrame(dict(zip(names, values, strict=True)))

    # Keys travel as text, since a null among whole numbers would make them floats.
    out = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType))


def not_prose(quality: DataFrame) -> DataFrame:
    """Keys of documents most of whose characters aren't prose."""
    return quality.where("kind not in ('blank', 'number') and list_part + table_part + junk > 0.5")
