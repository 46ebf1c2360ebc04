"""Text functions as columns: cleaning, grading, redaction and small formats.

Character classes are written out by code point, since what counts as white space or as a
letter differs between engines. Python runs on texts that hold presentation forms, and in the
grader, which counts the characters of whole batches.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What Python's str.isspace takes as white space.
SPACE = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
# Presentation forms that are folded, and what marks a garbled or unreadable text layer.
PRESENTATION = "[\\x{fb00}-\\x{fdff}\\x{fe70}-\\x{fefe}]"
MOJIBAKE = "[\\x{a1}-\\x{a6}\\x{a8}\\x{aa}\\x{ac}\\x{ad}\\x{af}\\x{b4}\\x{b6}\\x{b8}-\\x{ba}\\x{bf}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}ŒœŠšŸŽžƒˆ˜‰‹›†‡]"
ARABIC = "[\\x{600}-\\x{6ff}\\x{750}-\\x{77f}\\x{8a0}-\\x{8ff}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{fefc}]"
CONTROL = "[\\x{0}-\\x{8}\\x{e}-\\x{1b}\\x{7f}-\\x{84}\\x{86}-\\x{9f}]"
GLYPH = "/(?:[A-Za-z]{1,2}[0-9+]{1,6}|uni[0-9A-Fa-f]{4,6}|(?:NUL|SOH|STX|ETX|EOT|ENQ|ACK|BEL|BS|VT|FF|SO|SI|DLE|NAK|SYN|ETB|CAN|EM|SUB|ESC|FS|GS|RS|US|DEL)(?![A-Za-z]))"
# Shares of the non-space characters from which a page is junk or degraded.
LIMITS = {"glyph": 0.15, "control": 0.05, "pua": 0.10, "mojibake": 0.08, "arabic_floor": 0.30, "fffd": 0.15, "fffd_degraded": 0.02, "letters": 0.30, "single": 0.5}
LEAST_LETTERS, LEAST_WORDS = 20, 30
# Characters that the light normalisation takes as blanks, drops, or takes as blanks within a line.
_BLANK = "\\x{0}-\\x{9}\\x{b}-\\x{20}\\x{7f}-\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}"
_UNSEEN = "\\x{ad}\\x{200b}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2060}\\x{2066}-\\x{2069}\\x{feff}"
_EDGE = " \\x{2028}\\x{2029}"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def trim_unicode(c: Column) -> Column:
    return _sub(_sub(c, f"\\A{SPACE}+", ""), f"{SPACE}+\\z", "")


def normalize_light(c: Column) -> Column:
    """Line ends, controls, invisible characters, blanks and empty lines made regular; null stays null.

    A pattern matches what is irregular alone, so a regular text is only scanned: runs with
    anything but one space become a space, invisible characters vanish, and blanks around
    line ends and empty lines beyond one go in two steps.
    """
    c = _sub(c, "\\r\\n?", "\n")
    c = _sub(c, f"[{_UNSEEN}]*(?: [{_BLANK}{_UNSEEN}]+|[{_BLANK}&&[^ ]][{_BLANK}{_UNSEEN}]*)", " ")
    c = _sub(c, f"[{_UNSEEN}]+", "")
    c = _sub(c, f"[{_EDGE}]+\\n[{_EDGE}]*|\\n[{_EDGE}]+", "\n")
    return F.btrim(_sub(c, "\\n{3,}", "\n\n"), F.lit(" \n\u2028\u2029"))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    runs = re.compile("[ﬀ-﷿ﹰ-﻾]+")
    return s.map(lambda x: x and runs.sub(lambda m: unicodedata.normalize("NFKC", m.group()), x))


def clean_text(c: Column) -> Column:
    """normalize_light after folding presentation forms and dropping tatweel and replacement characters.

    Only texts that hold presentation forms are sent to Python.
    """
    folded = F.coalesce(_fold(F.when(c.rlike(PRESENTATION), c)), c)
    return normalize_light(_sub(folded, "[\\x{640}\\x{fffd}]", ""))


_SHARES = ("arabic", "letters", "glyph", "control", "pua", "fffd", "mojibake")
_KINDS = ("space", "alnum", "alpha", "arabic", "control", "pua", "fffd", "mojibake")
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """One byte a code point, one bit for each of ``_KINDS``; made once in a worker."""
    if not _kinds:
        every = [chr(i) for i in range(0x110000)]
        table = np.zeros(len(every), np.uint8)
        for bit, test in enumerate((str.isspace, str.isalnum, str.isalpha)):
            table |= np.fromiter(map(test, every), bool, len(every)).astype(np.uint8) << bit
        for bit, pattern in enumerate((ARABIC, CONTROL, "[\\x{e000}-\\x{f8ff}]", "\\x{fffd}", MOJIBAKE), 3):
            own = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m.group(1), 16)), pattern))
            found = np.fromiter((own.match(x) is not None for x in every[:0x10000]), bool, 0x10000)
            table[:0x10000] |= found.astype(np.uint8) << bit
        _kinds.append(table)
    return _kinds[0]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the kinds of all characters, where each text begins, with the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _kind_table()[codes], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _sums(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[edges])


def _lone_letters(kinds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words with a letter, those with one letter alone) of every text."""
    inside = kinds & 1 == 0
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    begins[edges[:-1][edges[:-1] < len(kinds)]] = inside[edges[:-1][edges[:-1] < len(kinds)]]
    word = np.cumsum(begins) - 1
    letters = np.bincount(word[(kinds & 4 > 0) & inside], minlength=max(1, int(begins.sum())))
    first = np.flatnonzero(begins)
    worded, lone = np.zeros(len(kinds), bool), np.zeros(len(kinds), bool)
    worded[first], lone[first] = letters[: len(first)] > 0, letters[: len(first)] == 1
    return _sums(worded, edges), _sums(lone, edges)


_COUNTED = T.StructType([T.StructField("chars", T.IntegerType()), *(T.StructField(k, T.DoubleType()) for k in (*_SHARES, "single")), T.StructField("words", T.IntegerType()), T.StructField("readable", T.IntegerType())])


@F.pandas_udf(_COUNTED)
def _counted(raw: pd.Series, clean: pd.Series) -> pd.DataFrame:
    glyphs = re.compile(GLYPH)
    parts = []
    for lot in np.array_split(np.arange(len(raw)), max(1, int(raw.str.len().sum()) >> 21)):
        texts, cleaned = raw.iloc[lot].tolist(), clean.iloc[lot].tolist()
        kinds, edges = _coded(texts)
        solid = kinds & 1 == 0
        n = _sums(solid, edges)
        counts = {name: _sums(solid & (kinds >> bit & 1 > 0), edges) for bit, name in enumerate(_KINDS) if bit > 2}
        counts["letters"] = _sums(solid & (kinds & 0b11110010 == 2), edges)  # none of the kinds that tell of damage
        counts["glyph"] = np.array([sum(len(m.group()) for m in glyphs.finditer(t)) if "/" in t else 0 for t in texts])
        kinds, edges = _coded(cleaned)
        words, lone = _lone_letters(kinds, edges)
        share = lambda x, y: [round(a / b, 4) if b else 0.0 for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        parts.append(pd.DataFrame({"chars": n, **{k: share(counts[k], n) for k in _SHARES}, "single": share(lone, words), "words": words, "readable": _sums(kinds & 2 > 0, edges)}))
    return pd.concat(parts, ignore_index=True)


def grade(df: DataFrame, text: str, out: str = "grade") -> DataFrame:
    """Adds struct<status, reasons, chars, and shares>: the grade of a text layer; null counts as empty.

    Accented Latin letters count as signs of a wrong decoding unless the text is Arabic,
    as the grader that is matched here has it. Words are those of the cleaned text, and one
    with a single letter is a broken one; their share is only told of texts that are
    neither junk nor empty. All characters of a batch are counted at once.
    """
    keep = df.columns
    counts = _counted(F.coalesce(F.col(text), F.lit("")), F.coalesce(clean_text(F.col(text)), F.lit("")))
    rows = df.select(*keep, counts.alias("__g"))
    g = lambda n: F.col(f"__g.{n}")
    why = lambda cond, name: F.when(cond, F.lit(name))
    listed = lambda *c: F.array_compact(F.array(*c))
    junk = listed(
        why(g("glyph") >= LIMITS["glyph"], "glyph-names"),
        why(g("control") >= LIMITS["control"], "control-chars"),
        why(g("pua") >= LIMITS["pua"], "private-use"),
        why((g("mojibake") >= LIMITS["mojibake"]) & (g("arabic") < LIMITS["arabic_floor"]), "mojibake"),
        why(g("fffd") >= LIMITS["fffd"], "replacement-chars"),
    )
    broken = (g("words") >= LEAST_WORDS) & (g("single") >= LIMITS["single"])
    weak = listed(why(g("fffd") >= LIMITS["fffd_degraded"], "replacement-chars"), why(broken, "broken-words"))
    rows = rows.select(*keep, "__g", junk.alias("__junk"), weak.alias("__weak"))
    damaged, empty = F.size("__junk") > 0, g("readable") < LEAST_LETTERS
    few = ~damaged & (g("chars") > 0) & (g("letters") < LIMITS["letters"])
    reasons = F.when(damaged, F.col("__junk")).when(few, F.array(F.lit("few-letters"))).when(empty, F.array(F.lit("no-text"))).otherwise(F.col("__weak"))
    status = F.when(damaged | few, "junk").when(empty, "empty").when(F.size("__weak") > 0, "degraded").otherwise("ok")
    single = F.when(~(damaged | few | empty), g("single"))
    return rows.select(*keep, F.struct(status.alias("status"), reasons.alias("reasons"), g("chars").alias("chars"), *(g(k).alias(k) for k in _SHARES), single.alias("single_letter_words")).alias(out))


# Query parameters that carry secrets, and the length at which a body is cut.
SECRET = "(?i)((?:[?&]|\\\\u0026)(?:token|access_token|key|sig|signature|x-goog-signature)=)[^&#\"'\\s\\\\]+"
BODY_CHARS = 2000


def redact_url(c: Column) -> Column:
    return _sub(F.coalesce(c, F.lit("")), SECRET, "$1<redacted>")


_PAYLOAD_HEAD = "\"fileBase64\"\\s*:\\s*\""


def redact_body(path: Column, body: Column, limit: int = BODY_CHARS) -> Column:
    """A request body fit for a log: page uploads summarised, payloads by their length, secrets hidden, the rest cut.

    Only an upload that is a JSON object whose pages are a list, or missing, has a summary.
    """
    upload = F.when(_sub(path, "/+$", "").endswith("/ingest/text"), F.try_parse_json(body))
    pages = F.coalesce(F.try_variant_get(upload, "$.pages", "array<variant>"), F.expr("array(cast(null as variant))"))
    texts = F.transform(pages, lambda p: F.length(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))))
    none = F.coalesce(F.to_json(F.try_variant_get(upload, "$.pages", "variant")), F.lit("null")) == "null"
    named = [x for k in ("notebookId", "sourceId", "fileName", "collection") for x in (F.lit(f'"{k}": '), F.coalesce(F.to_json(F.try_variant_get(upload, f"$.{k}", "variant")), F.lit("null")), F.lit(", "))]
    size = F.when(none, 0).otherwise(F.size(pages))
    summary = F.concat(F.lit("{"), *named, F.lit('"pages": '), size.cast("string"), F.lit(', "chars": '), F.aggregate(texts, F.lit(0), lambda a, n: a + n).cast("string"), F.lit("}"))
    fits = F.schema_of_variant(upload).startswith("OBJECT") & (none | F.try_variant_get(upload, "$.pages", "array<variant>").isNotNull())
    # What stands between the payloads, each with the payload after it.
    heads = F.regexp_extract_all(body, F.lit(f"({_PAYLOAD_HEAD})[^\"]*\""), F.lit(1))
    payloads = F.regexp_extract_all(body, F.lit(f"{_PAYLOAD_HEAD}([^\"]*)\""), F.lit(1))
    marks = F.zip_with(heads, payloads, lambda h, p: F.concat(h, F.lit("<"), F.length(p).cast("string"), F.lit(' base64 chars>"')))
    between = F.split(body, f"{_PAYLOAD_HEAD}[^\"]*\"", -1)
    short = redact_url(F.array_join(F.zip_with(between, marks, lambda x, m: F.concat(x, F.coalesce(m, F.lit("")))), ""))
    cut = F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("\n... [truncated "), (F.length(short) - limit).cast("string"), F.lit(" more chars]"))).otherwise(short)
    return F.when(F.coalesce(fits, F.lit(False)), summary).otherwise(cut)


def human_bytes(c: Column) -> Column:
    """Bytes in steps of 1024 up to PB; null stays null."""
    out = F.when(c < 1024, F.concat(c.cast("bigint").cast("string"), F.lit(" B")))
    units = ("KB", "MB", "GB", "TB", "PB")
    for i, unit in enumerate(units, 1):
        value = F.format_string(f"%.1f {unit}", c / float(1024**i))
        out = out.when(c < 1024.0 ** (i + 1), value) if i < len(units) else out.otherwise(F.when(c.isNotNull(), value))
    return out


def preview(c: Column, chars: int = 400) -> Column:
    return F.translate(F.substring(c, 1, chars), "\n", " ")


def no_figures(c: Column, sentinel: str = "no figures") -> Column:
    """Whether a reply says that there is nothing to describe, or says nothing."""
    core = trim_unicode(_sub(_sub(trim_unicode(F.coalesce(c, F.lit(""))), "\\A[.،!:]+", ""), "[.،!:]+\\z", ""))
    return (core == "") | (core == sentinel)


def figure_lines(c: Column, prefix: str = "[Figure]", sentinel: str = "no figures") -> Column:
    """The lines that describe figures; a reply without such lines gets the prefix as a whole."""
    text = clean_text(F.coalesce(c, F.lit("")))
    kept = F.filter(F.split(text, "\n"), lambda x: x.startswith(prefix))
    whole = F.when(text == "", "").otherwise(F.concat(F.lit(prefix + " "), text))
    return F.when(no_figures(c, sentinel), "").when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(whole)


def chunk_id(source: Column, index: Column) -> Column:
    return F.format_string("%s:%05d", source, index)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def history_text(turns: Column) -> Column:
    """Turns array<struct<role, content>> as lines ``Role: content``; no turns give a fixed remark."""
    lines = F.transform(turns, lambda t: F.concat(capitalize(t["role"]), F.lit(": "), F.coalesce(t["content"], F.lit(""))))
    return F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, "(no prior conversation)").otherwise(F.array_join(lines, "\n"))


def parse_pairs(c: Column) -> Column:
    """``a:1,b`` as array<struct<name, value>>; a missing value is null, blank items vanish."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: trim_unicode(x)), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(trim_unicode(F.regexp_extract(x, "^([^:]*)", 1)).alias("name"), F.nullif(trim_unicode(F.regexp_extract(x, ":(.*)$", 1)), F.lit("")).alias("value")))


# The form of a collection name and of a segment directory.
COLLECTION_NAME = "\\A[A-Za-z0-9][A-Za-z0-9_-]{1,61}[A-Za-z0-9]\\z"
SEGMENT_NAME = "\\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z"


def is_collection_name(c: Column) -> Column:
    return c.rlike(COLLECTION_NAME)


def is_segment_name(c: Column) -> Column:
    return c.rlike(SEGMENT_NAME)


def clean_ids(c: Column) -> Column:
    """Ids stripped, blanks and nulls dropped, the first of equals kept."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: trim_unicode(x)), lambda x: x.isNotNull() & (x != "")))
