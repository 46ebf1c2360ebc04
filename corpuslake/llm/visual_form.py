"""One form for texts that look alike (problem 2).

The mapping is made from Unicode's own data: letters, digits and signs that differ from
others in width, font or joining shape alone, blanks of every width, characters without
ink, hyphens and the minus; and from lists of letters of other scripts that are drawn like
Latin ones. It is compiled into a transducer that reads a text once, by the longest match
over grapheme clusters: a letter with its marks (also parted by something without ink), a
run of blanks and line breaks, or a run of single mapped characters.
``compile_transducer`` refuses rules that contradict each other, and runs the whole mapping
through itself: no output of a rule may be rewritten, so a second application changes
nothing.

Nulls give null, an empty text gives an empty text. Line breaks are kept, since a reader
sees them; every other blank, of any kind or width, becomes one space, and blanks at the
ends of lines vanish.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

# Letters of other scripts that are drawn like Latin ones, script by script.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеорсухіјѕԁһԛԝӀӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaeopcyxijsdhqwIl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovcj"
ARMENIAN = "ՍՕՏԼօոսհցզ"
ARMENIAN_AS = "UOSLonuhgq"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTiAJEWMHGZSVLCPKB"
OTHERS = "ıɑɡɩ"
OTHERS_AS = "iagi"
# Hyphens and minus signs drawn like U+002D; dashes are wider and stay.
HYPHENS = "‐‑﹣－−"
# Blanks that Unicode doesn't list as such, and characters without ink that aren't format characters.
MORE_BLANKS = "\t\x0b\x0c\x1f"
MORE_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0"
BREAKS = "\n\r\x85\u2028\u2029"
# Kinds of compatibility forms, as Unicode names them, that differ in width, font or joining shape alone.
SHAPES = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
# Ranges of ligatures and Roman numerals, which Unicode lists under a wider name.
LIGATURES = ((0xFB00, 0xFB06), (0x2160, 0x217F))
_DIGITS_AND_SIGNS = re.compile("[\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2]")  # format characters that are seen


def letter_rules() -> dict[str, str]:
    pairs = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (OTHERS, OTHERS_AS))
    return {a: b for x, y in pairs for a, b in zip(x, y, strict=True)}


def character_classes() -> tuple[str, str, str]:
    """(blanks, characters without ink, combining marks): from the categories of all code points."""
    blanks, unseen, marks = list(MORE_BLANKS), list(MORE_INVISIBLE), []
    for c in map(chr, range(0x10000)):  # above, there are marks of historic scripts only
        kind = unicodedata.category(c)
        if kind == "Zs":
            blanks.append(c)
        elif kind == "Cf" and not _DIGITS_AND_SIGNS.match(c) or 0xFE00 <= ord(c) <= 0xFE0F:
            unseen.append(c)
        elif kind in ("Mn", "Me") and unicodedata.combining(c) and c not in MORE_INVISIBLE:
            marks.append(c)
    return "".join(blanks), "".join(unseen), "".join(marks)


def rules() -> list[tuple[str, str]]:
    """Input and output of every rule for a single code point that isn't a blank, a break or without ink."""
    letters = letter_rules()
    out = [*letters.items(), *((c, "-") for c in HYPHENS)]
    seen = {*(i for i, _ in out), *MORE_INVISIBLE}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if c > "\uffff" and unicodedata.category(c) == "Cf":
            out.append((c, ""))
        kind = unicodedata.decomposition(c)
        if not kind or c in seen or unicodedata.category(c) in ("Zs", "Cf"):
            continue
        if kind.split(" ")[0] in SHAPES or any(low <= ord(c) <= high for low, high in LIGATURES):
            to = unicodedata.normalize("NFKC", c)
            if to != c and not to.startswith(" "):
                out.append((c, "".join("-" if x in HYPHENS else letters.get(x, x) for x in to)))
        elif kind[0] != "<":
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and base in letters:
                out.append((c, unicodedata.normalize("NFC", letters[base] + "".join(marks))))
            elif (to := unicodedata.normalize("NFC", c)) != c:
                out.append((c, "".join("-" if x in HYPHENS else letters.get(x, x) for x in to)))
    return out


def _ranges(characters: str) -> str:
    """The inside of a character class, neighbouring code points as ranges.

    What lies above the first plane is one range, since a class is asked of every character
    of every text; a character without a rule stays as it is when it is looked up.
    """
    codes, out = sorted({min(ord(c), 0x10000) for c in characters}), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    if out and out[-1][1] == 0x10000:
        out[-1][1] = sys.maxunicode
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


class Transducer:
    """Compiled rules; calling it with a text gives the text's one form."""

    def __init__(self, pairs: list[tuple[str, str]]):
        table: dict[str, str] = {}
        for source, target in pairs:
            if not source:
                raise ValueError("a rule needs an input")
            if table.setdefault(source, target) != target:
                raise ValueError(f"rules disagree on {source!r}: {table[source]!r} and {target!r}")
        blanks, unseen, marks = character_classes()
        if clash := set(table) & set(blanks + unseen + BREAKS):
            raise ValueError(f"a blank or unseen character has a rule: {min(clash)!r}")
        self.single = str.maketrans(table)
        self.blanks, self.known = frozenset(blanks), {}
        gaps, inkless, marked = _ranges(blanks + unseen + BREAKS), _ranges(unseen), _ranges(marks)
        words = "".join(f"{re.escape(k)}|" for k in sorted((k for k in table if len(k) > 1), key=len, reverse=True))
        mapped = _ranges("".join(k for k in table if len(k) == 1))
        special = _ranges("".join({*"".join(table), *blanks, *unseen, *BREAKS} - {" ", "\n"}))
        cluster = f"[^{gaps}{marked}][{inkless}]*[{marked}][{marked}{inkless}]*"
        # Most texts hold no mark: what has to change in them is found by one class of characters, and lone spaces and breaks are passed over.
        self.plain = re.compile(f"{words}[ \\n]*[{special}][{special} \\n]*|[ \\n]{{2,}}")
        self.part = re.compile(f"{words}(?P<gap>[{gaps}]+)|[{mapped}]+")
        self.whole = re.compile(f"(?P<cluster>{cluster})|{words}(?P<gap>[{gaps}]{{2,}}|[{_ranges(''.join(set(blanks + unseen + BREAKS) - {' ', chr(10)}))}])|(?:[{mapped}](?![{inkless}]*[{marked}]))+")
        self.has_mark = re.compile(f"[{marked}]")
        self.unseen = re.compile(f"[{inkless}]+")
        for source, target in table.items():
            if (again := self(target)) != target.strip(" \n"):
                raise ValueError(f"the output of {source!r} would be rewritten: {target!r} to {again!r}")
        for base in sorted({"".join(t) for t in table.values() if len(t) == 1}):
            for mark in map(chr, range(0x300, 0x315)):
                once = self(base + mark)
                if self(once) != once:
                    raise ValueError(f"{base!r} with a mark isn't stable")

    def _one(self, found: re.Match) -> str:
        text = found.group()
        if found.lastgroup == "gap":
            if breaks := text.count("\n") + text.count("\r") - text.count("\r\n") + text.count("\x85") + text.count("\u2028") + text.count("\u2029"):
                return "\n" * breaks
            return "" if self.blanks.isdisjoint(text) else " "
        if (to := self.known.get(text)) is None:
            to = text.translate(self.single)
            if found.lastgroup == "cluster":
                to = unicodedata.normalize("NFC", self.unseen.sub("", to))
                # A base and its marks may compose to what a rule maps, such as a letter of another script.
                to = to.translate(self.single)
            if len(self.known) < 100_000:
                self.known[text] = to
        return to

    def _run(self, found: re.Match) -> str:
        return self.part.sub(self._one, found.group())

    def __call__(self, text: str) -> str:
        if self.has_mark.search(text):
            return self.whole.sub(self._one, text).strip(" \n")
        return self.plain.sub(self._run, text).strip(" \n")


_compiled: list[Transducer] = []


def compile_transducer() -> Transducer:
    """The transducer of ``rules``; made once in a process."""
    if not _compiled:
        _compiled.append(Transducer(rules()))
    return _compiled[0]


_WORD = re.compile(r"[^\W\d_]+")
_TO_CYRILLIC = {a: c for c, a in zip(CYRILLIC, CYRILLIC_AS, strict=True) if c not in "ԁһԛԝЅЈѕјӀӏ"} | {"ë": "ё", "Ë": "Ё"}
_CYRILLIC_ONLY = re.compile("[Ѐ-ӿ]")
_LATIN_ONLY = re.compile("[^\\W\\d_" + re.escape("".join(_TO_CYRILLIC)) + "Ͱ-\u0600\u0600-￿]")


def readable(form: str) -> str:
    """The same form with words of Russian text back in Cyrillic.

    What a word becomes depends on the form alone, so equal forms stay equal.
    """
    if not _CYRILLIC_ONLY.search(form):
        return form
    cyrillic = len(_CYRILLIC_ONLY.findall(form)) > len(_LATIN_ONLY.findall(form))

    def word(found: re.Match) -> str:
        w = found.group()
        if _CYRILLIC_ONLY.search(w) or cyrillic and all(c in _TO_CYRILLIC for c in w):
            return "".join(_TO_CYRILLIC.get(c, c) for c in w)
        return w

    return _WORD.sub(word, form)


def visual_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form): every text in its one form; other columns are left out. Rows with null text give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compile_transducer()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "form": [None if x is None else readable(t(x)) for x in b["text"]]})

    # Keys travel as text, since a null among whole numbers would make them floats.
    out = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, form string")
    return out.withColumn("key", F.col("key").cast(df.schema[key].dataType))


def forms_of_tables(tables: list[tuple[str, DataFrame, str, str, str | None]]) -> DataFrame:
    """(table_name, key, form): the texts of several tables in their one form, keys as strings.

    ``tables``: as for ``look_alike_pairs``. With a version column a key has the text of its
    highest version alone, also if that is null; rows with a null key have no versions and
    are all kept.
    """
    parts = []
    for name, df, key, text, version in tables:
        if version:
            rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(version), F.lit(-(1 << 31))).alias("v"), F.col(text).alias("text"))
            valid = rows.where("k is not null").groupBy("k").agg(F.max_by(F.struct("text"), F.struct("v", "text")).alias("x")).select("k", "x.text")
            forms = visual_forms(valid.unionByName(rows.where("k is null").select("k", "text")), "k", "text")
        else:
            forms = visual_forms(df, key, text)
        parts.append(forms.select(F.lit(name).alias("table_name"), F.col("key").cast("string").alias("key"), "form"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _digests(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Adds 128-bit digests of the form and of the text itself and drops the text; short texts get no digest."""
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compile_transducer()
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            form, own = [], []
            for x in b["text"]:
                f = t(x) if x is not None and len(x) >= least else ""
                ok = len(f) >= 1
                form.append(digest(f) if ok else None)
                own.append(digest(x) if ok else None)
            yield b[columns].assign(form=form, own=own)

    return df.select(*columns, "text").mapInPandas(run, f"{kept}, form binary, own binary")


def _mixed(tables: list[tuple[str, DataFrame, str, str, str | None]], least: int) -> DataFrame:
    """(table_name, k, form, own): digests of the records whose form stands for two different strings at least; each once."""
    parts = []
    for name, df, key, text, version in tables:
        columns = ["k", *(["v"] if version else [])]
        rows = df.select(F.col(key).cast("string").alias("k"), *([F.coalesce(F.col(version), F.lit(-(1 << 31))).alias("v")] if version else []), F.col(text).alias("text")).where(F.col("k").isNotNull())
        rows = _digests(rows, columns, least)
        if version:
            rows = rows.groupBy("k").agg(F.max_by(F.struct("form", "own"), F.struct("v", "own")).alias("x")).select("k", "x.form", "x.own")
        parts.append(rows.where("form is not null").select(F.lit(name).alias("table_name"), "k", "form", "own"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = cut_lineage(rows)  # digests only; the texts are read once
    # Aggregated before the shuffle, so a form that very many records share is a few rows of it; the join back is split where it is skewed.
    mixed = rows.groupBy(GROUP).agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select(GROUP)
    return cut_lineage(rows.join(mixed, GROUP, "left_semi").distinct())


GROUP = ["table_name", "form"]


def look_alike_pairs(tables: list[tuple[str, DataFrame, str, str, str | None]], least: int = 40) -> DataFrame:
    """Pairs of records of one table that look the same and are not the same string.

    ``tables``: name, rows, key column, text column, version column or None. With a
    version column only the row with the highest version of a key counts. Rows with a
    null key, a null text or fewer than ``least`` characters pair with nothing. A key that
    is delivered twice with one text counts once. Groups are narrowed to those with two
    different strings before anything is joined, and the pairing runs over distinct
    strings, so copies of one string never meet each other. ``look_alike_classes`` says the
    same without pairs.
    """
    rows = _mixed(tables, least)
    strings = rows.select(*GROUP, "own").distinct()
    a, b = strings.withColumnRenamed("own", "own_a"), strings.withColumnRenamed("own", "own_b")
    pairs = a.join(b, GROUP).where("own_a < own_b")
    left = rows.select(*GROUP, F.col("own").alias("own_a"), F.col("k").alias("k_a"))
    right = rows.select(*GROUP, F.col("own").alias("own_b"), F.col("k").alias("k_b"))
    out = pairs.join(left, [*GROUP, "own_a"]).join(right, [*GROUP, "own_b"]).where("k_a <> k_b")
    return out.select("table_name", F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b")).distinct()


def look_alike_classes(tables: list[tuple[str, DataFrame, str, str, str | None]], least: int = 40) -> DataFrame:
    """(table_name, key, class, strings, records, partners): one row a record that has partners; its class, the different strings and the records of it.

    partners are the records of the class with another string. Takes what ``look_alike_pairs`` takes.
    """
    rows = _mixed(tables, least)
    own = rows.groupBy(*GROUP, "own").agg(F.count("*").alias("same"))
    all_ = own.groupBy(GROUP).agg(F.count("*").alias("strings"), F.sum("same").alias("records"))
    counted = own.join(all_, GROUP)
    return rows.join(counted, [*GROUP, "own"]).select("table_name", F.col("k").alias("key"), F.lower(F.hex("form")).alias("class"), "strings", "records", (F.col("records") - F.col("same")).alias("partners"))
