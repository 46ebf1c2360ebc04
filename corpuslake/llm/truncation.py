"""Replies cut off before their end (problem 4).

A stack automaton reads a text once: quotes, brackets, tags, emphasis and code are pushed
and popped; paragraphs reset all but tags and fences. Its state at the end, a broken multibyte sequence or escape
there, and the kind of the last line (prose, list entry, table row, caption, title)
decide whether something is missing. A missing terminator counts only where the source
usually sets one, measured on the prose lines inside its replies. Whether a last word is
whole is asked of a lexicon of all replies: a fragment seldom stands inside a text, and
more frequent words begin with it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

_PAIRS = {"“": "”", "«": "»", "„": "“", "(": ")", "[": "]", "{": "}", "¿": "?", "¡": "!", "‹": "›"}
_CLOSERS = set(_PAIRS.values())
_BOTH_WAYS = {"**", "__", "*", "_", "`", '"'}
#: Tags that nothing closes, or that may be left open.
_UNPAIRED = set("area base br col embed hr img input link meta source track wbr p li dt dd td th tr thead tbody tfoot option".split())
_MARKUP = re.compile(r"^[ \t]*(?P<fence>```|~~~)|\n\n|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9-]*)(?:\s[^<>\n]*?)?(?P<empty>/?)>|\*\*|__|[*_`\"]|[" + re.escape("".join({*_PAIRS, *_CLOSERS})) + "]", re.M)
_END = ".!?؟۔。"
_AFTER_END = "”»\"'’)]*_›"
# A mark that a cut may leave behind it.
_CUT_MARK = re.compile(r"(?:\s*(?:\.{3,4}|…|\[(?:…|\.\.\.)\]?|\((?:…|\.\.\.)\)?|�+))+\s*$")
_BROKEN = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?\w{1,8}|%[0-9A-F]?|<[/\w][^<>\n]{0,200})$")
_BULLET = re.compile(r"^\s*(?:[-*•·–—▪◦]|\d{1,3}[.)]|[a-z][.)])\s*")
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_LINE_END = re.compile(f"[{re.escape(_END)}][{re.escape(_AFTER_END)}\\s]*$")


def _open(text: str) -> list[str]:
    stack: list[str] = []
    fence = ""
    for m in _MARKUP.finditer(text):
        t = m.group()
        if mark := m.group("fence"):
            fence = "" if fence == mark else fence or mark
        elif fence:
            continue
        elif t[0] == "\n":
            stack = [x for x in stack if x[0] == "<"]
        elif name := m.group("tag"):
            tag = f"<{name.lower()}>"
            if m.group("end"):
                if tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            elif not m.group("empty") and name.lower() not in _UNPAIRED:
                stack.append(tag)
        elif t in _BOTH_WAYS:
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if t in stack and (t in "`\"" or before.strip() and not after.isalnum()):
                del stack[len(stack) - 1 - stack[::-1].index(t) :]
            elif t not in stack and after.strip() and not before.isalnum():  # no apostrophe, inch, product or bullet
                stack.append(t)
        elif "`" in stack:
            continue
        elif stack and t == _PAIRS.get(stack[-1]):
            stack.pop()
        elif t in _PAIRS:
            stack.append(t)
        elif t in (hit := [_PAIRS.get(s) for s in stack]):
            del stack[len(hit) - 1 - hit[::-1].index(t) :]
    return [*stack, *([fence] if fence else [])]


def open_at_end(text: str) -> str:
    """What is still open at the end of the text, outermost first."""
    return "".join(_open(text))


def _prose(line: str) -> bool:
    return len(line.split()) >= 6 and "|" not in line and not _BULLET.match(line)


def end_state(text: str) -> tuple[str, str, str]:
    """(state, reason, last word): state is whole, cut, terminator (whole if its source sets none) or word (ask the lexicon)."""
    body = text.rstrip()
    bare = _CUT_MARK.sub("", body).rstrip()
    marked = bare != body
    if not bare:
        return "whole", "", ""
    lines = bare.split("\n")
    last = lines[-1]
    before = lines[-2] if len(lines) > 1 else ""
    words = _WORD.findall(last)
    word = words[-1].lower() if words else ""
    if _BROKEN.search(body) and not _LINE_END.search(bare):
        return "cut", "broken sequence", word
    if last.lstrip().startswith("|"):
        if not last.rstrip().endswith("|"):
            return "cut", "table row", word
        rows = [x for x in lines[:-1] if x.lstrip().startswith("|")]
        return ("cut", "table row", word) if rows and last.count("|") < min(x.count("|") for x in rows) else ("whole", "", "")
    if left := _open(bare):
        return "cut", f"unclosed {left[-1]}", word
    if caption := re.match(r"\[[^\]\n]{1,20}\]\s*", last):
        items = [x.split() for x in last[caption.end() :].split(",")]
        if not items[-1] or len(items[-1]) < len(items[0]):
            return "cut", "caption", word
        return ("cut", "caption", word) if marked else ("word", "caption", word)
    entry = bool(_BULLET.match(last)) or bool(before.strip()) and not _prose(last) and len(words) <= 4 and (not _prose(before) or not _LINE_END.search(before) or len(words) <= 3)
    if entry and not _LINE_END.search(last):
        peers = [len(_WORD.findall(x)) for x in lines[:-1] if x.strip() and not _prose(x) and not _LINE_END.search(x)]
        if not words or peers and len(words) < min(peers) or not peers and len(words) < 2:
            return "cut", "list entry", word
        return ("cut", "list entry", word) if marked else ("word", "list entry", word)
    if not before.strip() and len(lines) == 1 and len(words) <= 4 and not _LINE_END.search(last) and (all(w[:1].isupper() or not w[:1].islower() for w in words) or len(words) <= 2):
        return ("cut", "title", word) if marked and words else ("word", "title", word)
    if not _LINE_END.search(last):
        return ("cut" if marked else "terminator"), "sentence", word
    return "whole", "", ""


def _states(replies: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, source, text in zip(b["result_id"], b["source_id"], b["text"], strict=True):
                state = end_state(text)
                inner = [x for x in text.rstrip().split("\n")[:-1] if _prose(x)]
                out.append((key, source, *state, len(inner), sum(bool(_LINE_END.search(x)) for x in inner)))
            yield pd.DataFrame(out, columns=["result_id", "source_id", "state", "reason", "word", "inner", "ended"])

    # Keys travel as text, since a null among whole numbers would make them floats.
    rows = replies.select(F.col("result_id").cast("string").alias("result_id"), "source_id", "text").where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
    return rows.mapInPandas(run, "result_id string, source_id string, state string, reason string, word string, inner int, ended int")


def _lexicon(replies: DataFrame) -> DataFrame:
    """(word, inside, n): how often a word stands inside a text and how often at all; counted in each partition before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inside, last = Counter(), Counter()
            for text in b["text"]:
                words = _WORD.findall(text.lower())
                inside.update(words[:-1])
                last.update(words[-1:])
            keys = list(inside | last)
            yield pd.DataFrame({"word": keys, "inside": [inside[k] for k in keys], "n": [inside[k] + last[k] for k in keys]}).astype({"word": "object", "inside": "int64", "n": "int64"})

    counts = replies.where("text is not null").select("text").mapInPandas(run, "word string, inside bigint, n bigint")
    return counts.groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("n").alias("n"))


def truncated(replies: DataFrame) -> DataFrame:
    """(result_id, source_id, is_cut, reason) for every reply whose text isn't null or blank.

    Neither finish_reason nor completion_tokens is read, since both mislead. A reply
    without a source is judged by the baseline of all sources.
    """
    states = cut_lineage(_states(replies))
    everywhere = states.agg(F.coalesce(F.try_divide(F.sum("ended"), F.sum("inner")), F.lit(1.0)).alias("everywhere")).scalar()
    by = states.groupBy("source_id").agg(F.sum("ended").alias("e"), F.sum("inner").alias("i")).where("source_id is not null")
    lexicon = cut_lineage(_lexicon(replies))
    asked = states.where("state = 'word' and word <> ''").select("word").distinct()
    own = lexicon.join(asked, "word")
    starts = lexicon.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word"), F.col("n").alias("longer"))
    longer = starts.join(asked, "word", "left_semi").groupBy("word").agg(F.max("longer").alias("longer"))
    fragments = own.join(longer, "word").where("inside < 0.25 * n and longer >= 4 * n").select("word", F.lit(True).alias("fragment"))
    rows = states.join(by, "source_id", "left").join(fragments, "word", "left")
    usual = (F.coalesce("e", F.lit(0)) + 3 * everywhere) / (F.coalesce("i", F.lit(0)) + 3)
    cut = (F.col("state") == "cut") | ((F.col("state") == "terminator") & (usual >= 0.5)) | ((F.col("state") == "word") & F.coalesce("fragment", F.lit(False)))
    return rows.select(F.col("result_id").cast("bigint").alias("result_id"), "source_id", cut.alias("is_cut"), F.when(cut, F.col("reason")).alias("reason"))


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """(source_id, replies, cut, cut_share); replies without a source are one group with a null source."""
    return judged.groupBy("source_id").agg(F.count("*").alias("replies"), F.count_if("is_cut").alias("cut"), (F.count_if("is_cut") / F.count("*")).alias("cut_share"))
