"""Text garbled by a wrong decoding (problem 7): found, explained and restored.

Garbled passages are joined with all their clean near-twins, passages that are equal in
ASCII and have the other characters at the same places. Every part outside ASCII of a
garbled passage votes once, for the pairs of encodings that make it of the same part of
any twin; parts that stand in clean passages more often than in odd ones have no vote. The
pairs of the fixed lists of encodings that win votes are the learned transformations; they are applied to
all records.
Multibyte readings are recognised by their byte pattern, single-byte readings by whether
the restored characters fit their neighbours better, by character pairs counted over all
texts. Replacement characters beside letters are lost for good and only reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

# Encodings a text may have been written in, and those it may have been read in.
WRITTEN = ("utf-8", "cp1252", "cp1256", "iso8859-6", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-roman", "cp850")
READ = ("latin-1", "cp1252", "mac-roman", "cp850", "cp437", "cp1251", "koi8-r", "cp1256", "cp866")
FAMILIES = [(w, r) for w in WRITTEN for r in READ]
#: Outcomes of misreading (two parts and a few numbers) that may be sent to every task; beyond it they are met by a shuffle.
MOST_OUTCOMES = 500_000
LEAST_VOTES, GAIN, LESSER_GAIN = 3, 6.0, 0.5
_PASSAGE = re.compile("[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*")
_SENTENCE = re.compile("[^.!?\n]+")
_ASCII_LETTER = re.compile("[A-Za-z]")
_NON_ASCII = re.compile("[^\x00-\x7f]+")
# What sound text rarely holds: the passages with it are the garbled side of the join.
_ODD = re.compile("[\x80-\x9f�¢-ª¬-¶¸-º¼-¾ƒ†‡ˆ‰ŠŒŽŸšž€™√∂∑∏π∫≈≠≤≥∞Ω─-▟]|[ÃÂØÙÐÑ][\x80-¿‘-”•–—˜™š›œžŸ€‚ƒ„…†‡ˆ‰Š‹]|[À-ÿ]{2}")


def _decoder(name: str) -> list[str]:
    """The character each byte is read as; undefined bytes stay control characters, as lenient readers leave them."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(i))
    return out


_READERS = {name: _decoder(name) for name in READ}


def misread(text: str, written: str, read: str) -> str | None:
    """What becomes of a text written in one encoding and read in another; None if it can't be written."""
    try:
        return "".join(_READERS[read][b] for b in text.encode(written))
    except UnicodeEncodeError:
        return None


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The parts outside ASCII of two near-twins, paired by the ASCII between them."""
    a, b = _NON_ASCII.findall(garbled), _NON_ASCII.findall(clean)
    if len(a) != len(b) or _NON_ASCII.split(garbled) != _NON_ASCII.split(clean):
        return []
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]


def explanations(garbled: str, clean: str) -> list[int]:
    """Positions in ``FAMILIES`` of the readings that make the clean part the garbled one; lenient readers may have dropped control characters."""
    out = []
    for i, (w, r) in enumerate(FAMILIES):
        m = misread(clean, w, r)
        if m is not None and m != clean and (m == garbled or re.sub("[\x80-\x9f]", "", m) == garbled):
            out.append(i)
    return out


@lru_cache(100_000)
def misreadings(clean: str) -> dict[str, list[int]]:
    """What the readings of ``FAMILIES`` make of a clean part, with their positions; the same relation as ``explanations``."""
    out: dict[str, list[int]] = {}
    for i, (w, r) in enumerate(FAMILIES):
        m = misread(clean, w, r)
        if m is not None and m != clean:
            for garbled in {m, re.sub("[\x80-\x9f]", "", m)} - {"", clean}:
                out.setdefault(garbled, []).append(i)
    return out


def _cover(votes: list[tuple[str, int]], least: int) -> list[tuple[str, str, int]]:
    """The fewest readings that explain the votes: the one with most first, then those for what is left."""
    left = [({int(i) for i in k.split()}, n) for k, n in votes if k]
    out = []
    while left:
        by: Counter = Counter()
        for ids, n in left:
            for i in ids:
                by[i] += n
        best, n = max(by.items(), key=lambda x: (x[1], -x[0]))
        if n < least:
            break
        out.append((*FAMILIES[best], n))
        left = [(ids, n) for ids, n in left if best not in ids]
    return out


def _gather(texts: DataFrame) -> DataFrame:
    """(kind, key, value, n): passages by what is left of them in ASCII and where the rest stood, their parts outside ASCII by the kind of
    passage they stand in, and pairs of neighbouring characters; counted in each partition first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages: Counter = Counter()
        for b in batches:
            texts = [t for t in b["text"] if t is not None and not t.isascii()]
            for a in range(0, len(texts), 2000):
                codes = np.frombuffer("\n".join(texts[a : a + 2000]).encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = np.where((codes == 10) | (codes == 13), 32, codes)
                x, y = codes[:-1], codes[1:]
                ok = ((x > 127) | (y > 127)) & (x < 0x2700) & (y < 0x2700)
                pair, n = np.unique(x[ok].astype(np.int64) << 16 | y[ok], return_counts=True)
                yield pd.DataFrame({"kind": "pair", "key": pair.astype(str), "value": "", "n": n})
            for t in texts:
                if len(_ASCII_LETTER.findall(t)) * 3 > len(t):
                    passages.update(_PASSAGE.findall(t))
                else:
                    passages.update(s.strip() for s in _SENTENCE.findall(t))
            if len(passages) > 100_000:
                yield _passage_rows(passages)
                passages = Counter()
        yield _passage_rows(passages)

    return texts.mapInPandas(run, "kind string, key string, value string, n bigint")


def _passage_rows(passages: Counter) -> pd.DataFrame:
    rows = [("odd" if _ODD.search(p) else "clean", _NON_ASCII.sub("\ufffd", p), p, n) for p, n in passages.items()]
    parts: Counter = Counter()
    for kind, _, p, n in rows:
        for x in _NON_ASCII.findall(p):
            parts[kind, x] += n
    rows = [r for r in rows if len(re.sub("[^A-Za-z0-9]", "", r[1])) >= 3]
    rows += [("part", x, kind, n) for (kind, x), n in parts.items()]
    return pd.DataFrame(rows, columns=["kind", "key", "value", "n"]).astype({"kind": "object", "key": "object", "value": "object", "n": "int64"})


class Repairer:
    """The learned transformations and the pair counts, ready to judge passages."""

    def __init__(self, families: list[tuple[str, str]], pairs: dict[int, int]):
        self.pairs = pairs
        self.multi: list[tuple[re.Pattern, dict[str, int], str]] = []
        self.single: list[dict[str, str]] = []
        self.cache: dict[str, tuple | None] = {}
        for w, r in families:
            table = _READERS[r]
            if w == "utf-8":
                char = lambda lo, hi, t=table: "[" + re.escape("".join(t[i] for i in range(lo, hi))) + "]"
                cont = char(0x80, 0xC0)
                self.multi.append((re.compile(f"(?:{char(0xC3, 0xE0)}|{char(0xC2, 0xC3)}){cont}|{char(0xE1, 0xF0)}{cont}{cont}|{char(0xF0, 0xF5)}{cont}{cont}{cont}"), {c: i for i, c in enumerate(table)}, r))
            else:
                back = {}
                for i in range(128, 256):
                    try:
                        to = bytes([i]).decode(w)
                    except UnicodeDecodeError:
                        continue
                    if to != table[i] and _sound(to):
                        back[table[i]] = to
                self.single.append(back)

    def _decode(self, found: re.Match, codes: dict[str, int]) -> str:
        text = found.group()
        try:
            to = bytes(codes[c] for c in text).decode("utf-8")
        except (UnicodeDecodeError, KeyError, ValueError):
            return text
        return to if _sound(to) else text

    def _score(self, text: str, places: list[int]) -> float:
        edges = {i for p in places for i in (p, p + 1)}
        padded = " " + text + " "
        return sum(math.log(self.pairs.get(ord(padded[i]) << 16 | ord(padded[i + 1]), 0) + 0.5) for i in edges if ord(padded[i]) < 0x2700 and ord(padded[i + 1]) < 0x2700)

    def whole(self, text: str) -> str | None:
        """The text as it was meant, or None if nothing in it is garbled.

        A record that was read in a wrong single-byte encoding was read in one of them, so
        the one that its passages favour together is applied to all of them.
        """
        passages = _PASSAGE.findall(text)
        found = [self.judge(p) for p in passages]
        # A letter that stands alone proves nothing by itself.
        if not any(x is not None and (x[0] is not None or len(p) > 1) for x, p in zip(found, passages, strict=True)):
            # A lost mark between words can't be restored, but it tells; in a text without letters it is a glyph nobody could read.
            lost = text.count("\ufffd")
            return text if lost and sum(map(str.isalpha, text)) >= 5 * lost else None
        total: Counter = Counter()
        for x in found:
            if x is not None and x[0] is None:
                total.update({i: g for i, (_, g) in x[1].items()})
        best = max(total, key=lambda i: (total[i], -i)) if total else None

        def one(m: re.Match) -> str:
            x = self.judge(m.group())
            if x is None:  # in a record that is known to be garbled a lesser gain will do
                return self._single(m.group(), LESSER_GAIN).get(best, (m.group(),))[0] if best is not None else m.group()
            return x[0] if x[0] is not None else x[1].get(best, (m.group(),))[0]

        return _PASSAGE.sub(one, text)

    def judge(self, passage: str) -> tuple[str | None, dict[int, tuple[str, float]]] | None:
        """None for a sound passage, else its restored text or, for single-byte readings, the text and the gain of each that fits."""
        if passage in self.cache:
            return self.cache[passage]
        single = self._single(passage)
        text = passage
        for _ in range(3):
            best = text
            for pattern, codes, _name in self.multi:
                to = pattern.sub(lambda m, c=codes: self._decode(m, c), text)
                if len(to) < len(best):
                    best = to
            if best == text:
                break
            text = best
        # A reading of several bytes as one character each leaves a mix of scripts if it was no such reading.
        if text != passage and not (single and self._mixed(text)):
            out = (text, {})
        elif single:
            out = (None, single)
        elif text != passage or "â€" in text or "�" in text and any(c.isalpha() for c in text):
            out = (text, {})
        else:
            out = None
        if len(self.cache) < 200_000:
            self.cache[passage] = out
        return out

    @staticmethod
    def _mixed(text: str) -> bool:
        foreign = sum(c.isalpha() and 0x370 <= ord(c) < 0x700 for c in text)
        return foreign > 0 and foreign < sum(c.isalpha() for c in text) or foreign == 0 and sum(0xC0 <= ord(c) < 0x180 for c in text) > 2

    def _single(self, passage: str, least: float = GAIN) -> dict[int, tuple[str, float]]:
        out = {}
        for i, back in enumerate(self.single):
            places = [j for j, c in enumerate(passage) if c in back]
            if not places:
                continue
            to = "".join(back.get(c, c) for c in passage)
            letters = [0x370 <= ord(c) < 0x700 for c in to if c.isalpha()]
            if any(letters) and (not all(letters) or any(0x370 <= ord(c) < 0x700 for c in passage if c.isalpha())):
                continue  # a word is of one script, and what was garbled into Latin signs held none of its own
            g = self._score(to, places) - max(self._score(passage, places), self._score(passage.lower(), places) if len(passage.lower()) == len(passage) else -math.inf)
            if g > least:
                out[i] = (to, g)
        return out


def _sound(text: str) -> bool:
    """Whether characters are letters or marks of the scripts at hand, and not fragments of other blocks."""
    for c in text:
        o = ord(c)
        if not (0xA0 <= o < 0x180 or 0x386 <= o < 0x3CF or 0x400 <= o < 0x460 or o in (0x60C, 0x61B, 0x61F) or 0x621 <= o < 0x653 or 0x660 <= o < 0x66A or o in (0x67E, 0x686, 0x698, 0x6A9, 0x6AF, 0x6CC, 0x6D4) or 0x2010 <= o < 0x2040 or o in (0x20AC, 0x2122, 0x192, 0x2C6, 0x2DC, 0xFEFF, 0xFFFD) or 0x1F300 <= o < 0x1FB00):
            return False
    return True


def learn(texts: DataFrame, least: int = LEAST_VOTES) -> tuple[Repairer, list[tuple[str, str, int]]]:
    """A repairer from all texts, and the votes of each pair of encodings.

    Each part of a garbled passage meets the parts of all clean passages of its key, by
    what the readings make of them, so no two passages are compared and a key with many
    passages costs no more than they are. What reaches the driver is bounded by the
    alphabets and the encodings.
    """
    gathered = cut_lineage(_gather(texts))
    counts = gathered.where("kind = 'pair'").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    pairs = dict(zip(counts["key"].astype("int64"), counts["n"].astype("int64"), strict=True))
    odd = gathered.where("kind = 'odd'").select("key", "value").distinct()
    clean = gathered.where("kind = 'clean'").select("key", "value").join(odd.select("key").distinct(), "key", "left_semi")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, x) for k, v in zip(b["key"], b["value"], strict=True) for i, x in enumerate(_NON_ASCII.findall(v))]
            yield pd.DataFrame(rows, columns=["key", "at", "part"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 1000):
                rows = [(y, x, ids) for y in b["part"].iloc[a : a + 1000] for x, ids in misreadings(y).items()]
                yield pd.DataFrame(rows, columns=["part", "garbled", "ids"])

    place = ["key", "at", "part"]
    parts = cut_lineage(odd.mapInPandas(split, "key string, at int, part string"))
    places = cut_lineage(clean.mapInPandas(split, "key string, at int, part string").distinct())
    # What becomes of a part doesn't depend on its place: each different part is misread once, and kept are outcomes that some garbled passage shows.
    outcomes = places.select("part").distinct().mapInPandas(read, "part string, garbled string, ids array<int>")
    outcomes = cut_lineage(outcomes.join(parts.select(F.col("part").alias("garbled")).distinct(), "garbled", "left_semi"))
    if outcomes.count() <= MOST_OUTCOMES:
        outcomes = F.broadcast(outcomes)
    made = places.join(outcomes, "part").select("key", "at", F.col("garbled").alias("part"), "ids")
    made = made.join(parts.distinct(), place, "left_semi").groupBy(place).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))), " ").alias("families"))
    # A part that stands more often in clean passages than in odd ones is sound where it meets a twin by chance, and votes for nothing.
    sides = gathered.where("kind = 'part'").groupBy(F.col("key").alias("part")).agg(F.sum(F.when(F.col("value") == "odd", F.col("n")).otherwise(-F.col("n"))).alias("odder"))
    votes = parts.join(made, place).join(sides.where("odder >= 0"), "part").withColumn("n", F.lit(1))
    won = [(r["families"], r["n"]) for r in votes.groupBy("families").agg(F.sum("n").alias("n")).collect()]
    learned = _cover(won, least)
    return Repairer([(w, r) for w, r, _ in learned], pairs), learned


def garbled_records(tables: list[tuple[str, DataFrame, str, str]], least: int = LEAST_VOTES) -> DataFrame:
    """(table_name, record_id, restored): records with a garbled character, and their text as far as it could be restored.

    ``tables``: name, rows, key column, text column. Null and pure ASCII texts are sound.
    Rows with a null key are judged too and keep it. Texts are read whole; a record counts
    by its own key, also if it is delivered twice.
    """
    parts = [df.select(F.lit(n).alias("table_name"), F.col(k).cast("bigint").cast("string").alias("record_id"), F.col(t).alias("text")) for n, df, k, t in tables]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.col("text").rlike("[^\\x00-\\x7f]"))
    repairer, _ = learn(rows.select("text"), least)
    shared = rows.sparkSession.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = shared.value
        for b in batches:
            out = []
            for name, key, text in zip(b["table_name"], b["record_id"], b["text"], strict=True):
                if (restored := fix.whole(text)) is not None:
                    out.append((name, key, restored))
            yield pd.DataFrame(out, columns=["table_name", "record_id", "restored"])

    # Keys travel as text, since a null among whole numbers would make them floats.
    return rows.mapInPandas(run, "table_name string, record_id string, restored string").withColumn("record_id", F.col("record_id").cast("bigint"))
