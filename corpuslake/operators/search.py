"""Exact nearest neighbours. Queries are a stated set, the searched side may be any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.vectors import LEAST_NORM

MOST_QUERY_BYTES = 64 << 20


def _distances(q: np.ndarray, e: np.ndarray, space: str) -> np.ndarray:
    if space == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), LEAST_NORM)
        e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), LEAST_NORM)
        return 1 - q @ e.T
    if space == "ip":
        return 1 - q @ e.T
    return np.stack([((e - x) ** 2).sum(axis=1) for x in q]) if len(q) else np.zeros((0, len(e)))


def knn(base: DataFrame, queries: DataFrame, k: int, space: str = "l2", key: str = "id", vector: str = "embedding", same: str | None = None, drop_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of ``base`` for every query, equal distances by id.

    ``same`` names a column that must agree between query and row. Vectors that are null
    or of another length than the query's take no part. Every batch of ``base`` is compared
    with a block of queries by one matrix product and keeps its own k best, so what is
    shuffled is k rows per query and batch. Query sets above 64 MB are searched in blocks.
    """
    cols = [F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), *([F.col(same).cast("string").alias("s")] if same else [F.lit("").alias("s")])]
    kind = base.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*cols)
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n * width * 8 // MOST_QUERY_BYTES))
    out = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.toPandas()  # at most one block, whose size is checked above
        hits = _scan(base, rows, k + drop_self, space, key, vector, same, kind)
        out = hits if out is None else out.unionByName(hits)
    if drop_self:
        out = out.where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _scan(base: DataFrame, rows: pd.DataFrame, k: int, space: str, key: str, vector: str, same: str | None, kind: str) -> DataFrame:
    sizes = {len(v) for v in rows["v"]}
    packs = []
    for size in sizes:
        r = rows[[len(v) == size for v in rows["v"]]]
        packs.append((size, r["query_id"].to_numpy(), np.array(r["v"].tolist(), np.float64).reshape(len(r), size), r["s"].to_numpy(object)))
    shared = base.sparkSession.sparkContext.broadcast(packs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = np.array([len(v) for v in b["v"]])
            for size, ids, q, s in shared.value:
                part = b[lengths == size]
                if not len(part):
                    continue
                e = np.array(part["v"].tolist(), np.float64).reshape(len(part), size)
                own, group = part["id"].to_numpy(), part["s"].to_numpy(object)
                order = np.argsort(own, kind="stable")
                e, own, group = e[order], own[order], group[order]
                for a in range(0, len(q), 256):
                    d = _distances(q[a : a + 256], e, space)
                    if same:
                        d = np.where(s[a : a + 256, None] == group[None, :], d, np.inf)
                    m = min(k, d.shape[1])
                    bound = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
                    i, j = np.nonzero((d <= bound) & np.isfinite(d))
                    yield pd.DataFrame({"query_id": ids[a : a + 256][i], "id": own[j], "distance": d[i, j]})

    side = [F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(same).cast("string") if same else F.lit("")).alias("s")]
    return base.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*side).mapInPandas(run, f"query_id {kind}, id {kind}, distance double")


def similarity(distance: Column) -> Column:
    return F.round(1 - distance, 6)


def merge_round_robin(results: DataFrame, group: list[str], k: int) -> DataFrame:
    """Ranked lists of several queries merged by (rank, query): each id, or content where the id is missing, once with its least distance.

    ``results``: group columns, query_index, rank, id, content, distance.
    """
    who = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("content"))
    place = F.struct("rank", "query_index")
    rows = results.groupBy(*group, who.alias("who")).agg(F.min(place).alias("place"), F.min("distance").alias("distance"), F.min_by("id", place).alias("id"), F.min_by("content", place).alias("content"))
    order = F.row_number().over(Window.partitionBy(*group).orderBy("place", "who"))
    return rows.withColumn("position", order).where(F.col("position") <= k).select(*group, "position", "id", "content", "distance")


def merge_dedupe(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary, then what of secondary has contents not seen before, in its order; repeats inside primary stay.

    Both need content and seq, which gives their order; the result has part and seq to order by.
    """
    first = Window.partitionBy("content").orderBy("seq")
    extra = secondary.join(primary.select("content").distinct(), "content", "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return primary.withColumn("part", F.lit(0)).unionByName(extra.withColumn("part", F.lit(1)))


def rerank(candidates: DataFrame, replies: DataFrame, group: str) -> DataFrame:
    """Candidates (group, rank, ...) in the order a reply names: ``{"order": [1-based ranks]}``.

    Numbers out of range and repeats are dropped, candidates that aren't named follow in
    their old order. A null or broken reply changes nothing. Adds new_rank and delta.
    """
    named = replies.select(group, F.posexplode(F.array_distinct(F.from_json("reply", "struct<order:array<int>>")["order"])).alias("at", "rank"))
    rows = candidates.join(named, [group, "rank"], "left")
    order = F.row_number().over(Window.partitionBy(group).orderBy(F.col("at").asc_nulls_last(), "rank"))
    return rows.withColumn("new_rank", order).withColumn("delta", F.col("rank") - F.col("new_rank")).drop("at")


def same_content_first(ranked: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Reranked rows whose contents are equal all show the first candidate with that content: a reranker names contents, not rows.

    ``columns`` are taken from that candidate, and rank too, which delta follows.
    """
    first = Window.partitionBy(group, "content")
    rows = ranked.withColumn("__first", F.min_by(F.struct("rank", *columns), "rank").over(first))
    rows = rows.withColumns({c: F.col(f"__first.{c}") for c in ("rank", *columns)}).drop("__first")
    return rows.withColumn("delta", F.col("rank") - F.col("new_rank"))


def attribution(results: DataFrame, group: list[str]) -> DataFrame:
    """Results by where they come from: count, least distance and the first row's ids; most first, equal counts by first appearance."""
    label = F.coalesce(F.nullif("source_id", F.lit("")), F.nullif("source", F.lit("")), F.lit("(unknown)"))
    rows = results.groupBy(*group, label.alias("label")).agg(F.count("*").alias("chunks"), F.min("distance").alias("best_distance"), F.min_by("id", "rank").alias("first_id"), F.min("rank").alias("first_rank"))
    order = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("chunks"), "first_rank"))
    return rows.withColumn("position", order)


def last_turns(turns: DataFrame, group: str, order: list[str], n: int = 6) -> DataFrame:
    """(group, turns): the last n turns (role, content) in order; the window keeps n rows a group before anything is gathered."""
    back = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in order)))
    rows = turns.withColumn("__back", back).where(F.col("__back") <= n)
    gathered = F.array_sort(F.collect_list(F.struct((-F.col("__back")).alias("at"), "role", "content")))
    return rows.groupBy(group).agg(F.transform(gathered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
