"""Long exact spans shared between records (problem 10), by De Bruijn compaction.

Tokens are code points, since lengths are counted in them. k-mers of ``k`` tokens are the
edges; of every ``span - k`` neighbouring k-mers only one chosen by its hash is kept
(winnowing), so that any shared span of ``span`` tokens holds a kept k-mer in both records
and neighbours overlap without gaps. Edges seen in one group only are dropped. Paths on
which every edge has one successor and one predecessor are compacted by joins, so a long
repeat is one row per record instead of one per edge. Source coordinates and the text on
both sides of a path then verify the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

#: Document keys that may be sent to every task, 8 bytes each; beyond it they meet the texts in the shuffle.
MOST_KEYS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64) if n else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def kmer_hashes(text: str, k: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
        return _mix((sums[k:] - sums[:-k]) * _powers(inverse, n - k + 1))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash, the last one of equals, in every window; a shorter text is one window."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    out = [np.argmin(views[i : i + 4096], axis=1) + np.arange(i, min(i + 4096, len(views))) for i in range(0, len(views), 4096)]
    return np.unique(n - 1 - np.concatenate(out))


def _edges(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(doc, page, pos, edge): the kept k-mers of every record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                places, hashes = [], []
                for text in part["text"]:
                    h = kmer_hashes(text, k)
                    at = winnow(h, span - k)
                    places.append(at)
                    hashes.append(h[at])
                n = [len(x) for x in places]
                yield pd.DataFrame({"doc": np.repeat(part["doc"].to_numpy(), n), "page": np.repeat(part["page"].to_numpy(), n), "pos": np.concatenate(places).astype(np.int32), "edge": np.concatenate(hashes).view(np.int64)})

    return docs.mapInPandas(run, "doc bigint, page string, pos int, edge bigint")


def _paths(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(path, doc, page, start, end, left, right): each compacted path where it occurs, with the text beside it as far as it can matter; ``end`` is where its last edge starts."""
    edges = cut_lineage(_edges(docs, span, k))
    pages = edges.groupBy("edge").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("edge")
    rows = cut_lineage(edges.join(pages, "edge", "left_semi"))
    along = Window.partitionBy("doc").orderBy("pos")
    near = rows.select("doc", "page", "pos", "edge", F.lead(F.struct("edge", "pos")).over(along).alias("n"), F.lag(F.struct("edge", "pos")).over(along).alias("p"))
    # A link is the neighbour's edge and its distance; neighbours further off than the window aren't linked.
    step = lambda c, d: F.when(d <= span - k, F.struct(f"{c}.edge", d.alias("step"))).alias(c)
    near = near.select("doc", "page", "pos", "edge", step("n", F.col("n.pos") - F.col("pos")), step("p", F.col("pos") - F.col("p.pos")))
    link = lambda c: F.coalesce(F.xxhash64(f"{c}.edge", f"{c}.step"), F.lit(0))
    one = lambda c: (F.min(link(c)) == F.max(link(c))) & (F.count(c) == F.count("*"))
    degree = near.groupBy("edge").agg(one("n").alias("one_out"), one("p").alias("one_in"))
    joined = near.select("doc", "page", "pos", "edge").join(degree, "edge")
    # The link to the edge before is unbranched if that edge has one way out and this one a single way in.
    solid = F.col("one_in") & F.lag("one_out").over(along)
    begins = joined.select("doc", "page", "pos", "edge", F.when(F.coalesce(solid, F.lit(False)), 0).otherwise(1).alias("begin"))
    begins = begins.withColumn("nr", F.sum("begin").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = begins.groupBy("doc", "page", "nr").agg(F.min_by("edge", "pos").alias("path"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    # Only texts that hold a path are needed. Their keys are sent to all tasks if they are few, so that other texts stay out of the shuffle.
    spans, texts = cut_lineage(spans), docs.select("doc", "text")
    holders = spans.select("doc").distinct()
    if holders.count() <= MOST_KEYS:
        texts = texts.join(F.broadcast(holders), "doc", "left_semi")
    side = span - k
    left = F.substring("text", F.greatest(F.lit(0), F.col("start") - side) + 1, F.least(F.lit(side), F.col("start")))
    right = F.substring("text", F.col("end") + k + 1, F.lit(side))
    return spans.join(texts, "doc").select("path", "doc", "page", "start", "end", left.alias("left"), right.alias("right"))


def shared_spans(docs: DataFrame, key: str = "doc_id", group: str = "page_id", text: str = "text", span: int = 200, k: int = 100) -> DataFrame:
    """(doc_a, start_a, doc_b, start_b, length): stretches of at least ``span`` characters that stand in two records of different groups.

    A long shared stretch may come in several overlapping rows. Every key with a row is
    one record; a null group is a group of its own for each record; rows with a null key
    or text, and texts shorter than ``span``, share nothing. A key that repeats is taken
    as one record with the greatest text. Pairs are formed between groups first, so that
    many records of one group never meet each other.
    """
    if not 0 < k < span:
        raise ValueError("k must be below span")
    rows = docs.where(F.col(key).isNotNull() & (F.length(text) >= span)).select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("r"), F.col(key).cast("string"))).alias("page"), F.col(text).alias("text"))
    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc").agg(F.max(F.struct("text", "page")).alias("x")).select("doc", "x.page", "x.text")
    paths = cut_lineage(_paths(rows, span, k))
    groups = paths.select("path", "page").distinct()
    a, b = groups.withColumnRenamed("page", "page_a"), groups.withColumnRenamed("page", "page_b")
    met = a.join(b, "path").where("page_a < page_b")
    side = lambda x: paths.select("path", F.col("page").alias(f"page_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "start", "end", "left", "right")))
    pairs = met.join(side("a"), ["path", "page_a"]).join(side("b"), ["path", "page_b"]).where("doc_a <> doc_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for da, sa, ea, la, ra, db, sb, lb, rb in zip(b.doc_a, b.start_a, b.end_a, b.left_a, b.right_a, b.doc_b, b.start_b, b.left_b, b.right_b, strict=True):
                before = len(la) if la == lb else len(commonprefix((la[::-1], lb[::-1])))
                after = len(ra) if ra == rb else len(commonprefix((ra, rb)))
                if (n := before + ea - sa + k + after) >= span:
                    out.append((da, sa - before, db, sb - before, n) if da < db else (db, sb - before, da, sa - before, n))
            yield pd.DataFrame(out, columns=["doc_a", "start_a", "doc_b", "start_b", "length"])

    return pairs.select("doc_a", "start_a", "end_a", "left_a", "right_a", "doc_b", "start_b", "left_b", "right_b").mapInPandas(run, "doc_a bigint, start_a int, doc_b bigint, start_b int, length int")


def shared_part(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, shared_chars, shared_share, partners) for every record with a key; texts without shared stretches have 0."""
    one = lambda x, y: spans.select(F.col(f"doc_{x}").alias("doc"), F.col(f"start_{x}").alias("s"), (F.col(f"start_{x}") + F.col("length")).alias("e"), F.col(f"doc_{y}").alias("partner"))
    both = one("a", "b").unionByName(one("b", "a"))
    stretches = both.groupBy("doc", "s").agg(F.max("e").alias("e"))
    seen = F.max("e").over(Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    new = stretches.withColumn("seen", F.coalesce(seen, F.lit(0))).select("doc", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "seen")).alias("n"))
    shared = new.groupBy("doc").agg(F.sum("n").alias("shared_chars"))
    partners = both.select("doc", "partner").distinct().groupBy("doc").agg(F.count("*").alias("partners"))
    out = docs.select(F.col(key), F.length(F.coalesce(text, F.lit(""))).alias("n_chars")).where(F.col(key).isNotNull())
    out = out.join(shared, out[key] == shared["doc"], "left").drop("doc").join(partners, out[key] == partners["doc"], "left").drop("doc")
    share = F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0))
    return out.select(key, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), share.alias("shared_share"), F.coalesce("partners", F.lit(0)).alias("partners"))
