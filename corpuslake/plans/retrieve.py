"""From a question to its chunks: scope, rewriting, embedding, search, merging, reranking, trimming."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import history_text
from corpuslake.operators import filters, rollup, search
from corpuslake.plans.catalog import Catalog, Flags
from corpuslake.plans.providers import QUERY, Embedder, lexical_order, same_question
from corpuslake.plans.requests import Retrieve, Trace

CANDIDATES, LAST_TURNS = 20, 6
Order = Callable[[Column, Column], Column]
Rewrite = Callable[[Column, Column | None], Column]
_RESULT = ["id", "notebook_id", "source_id", "source", "page_start", "page_end", "content"]


def conversation(turns: list[tuple[str, str]]) -> Column:
    """The last six turns (role, content) of a request as the lines a rewriting model is shown."""
    last = [F.struct(F.lit(role).alias("role"), F.lit(content).alias("content")) for role, content in turns[-LAST_TURNS:]]
    return history_text(F.array(*last) if last else F.lit(None).cast("array<struct<role:string,content:string>>"))


def _asked(chunks: DataFrame, questions: list[str], embedder: Embedder, flags: Flags, rewrite: Rewrite = same_question, turns: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = chunks.sparkSession.createDataFrame(list(enumerate(questions)), "query_index int, question string")
    rows = rows.withColumn("asked", rewrite(F.col("question"), conversation(turns or [])))
    embedded = embedder.embed(rows, "asked", flags.normalized, QUERY if flags.task_types else None)
    return embedded.select(F.col("query_index").cast("string").alias("id"), "question", "asked", "embedding")


def retrieve(catalog: Catalog, collection: str, request: Retrieve, embedder: Embedder, order: Order | None = lexical_order, rewrite: Rewrite = same_question) -> DataFrame:
    """(position, id, ..., distance) for a request; several queries are merged by rank, one is reranked if that can change what is kept."""
    flags = catalog.flags(collection)
    chunks = catalog.read(collection).where(filters.scope(request.notebooks, request.sources))
    questions = request.queries or [request.question]
    asked = _asked(chunks, questions, embedder, flags, rewrite if not request.queries else same_question, request.history)
    wide = request.k if request.queries else max(CANDIDATES, request.k)
    hits = search.knn(chunks, asked, wide, flags.space)
    rows = hits.join(chunks.select(*_RESULT), "id")
    if request.queries:
        merged = search.merge_round_robin(rows.withColumn("query_index", F.col("query_id").cast("int")).withColumn("one", F.lit(0)), ["one"], request.k)
        return merged.select("position", "id", "distance").join(chunks.select(*_RESULT), "id").orderBy("position")
    if order is not None:
        listed = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.substring(x["content"], 1, 400)).alias("contents"))
        replies = listed.where(F.size("contents") > request.k).join(asked.select(F.col("id").alias("query_id"), "asked"), "query_id").select("query_id", order(F.col("asked"), F.col("contents")).alias("reply"))
        rows = search.rerank(rows, replies, "query_id").withColumn("position", F.col("new_rank"))
    else:
        rows = rows.withColumn("position", F.col("rank"))
    return rows.where(F.col("position") <= request.k).select("position", *_RESULT, "distance").orderBy("position")


def traced(catalog: Catalog, collection: str, request: Trace, embedder: Embedder, order: Order = lexical_order, rewrite: Rewrite = same_question) -> tuple[DataFrame, DataFrame]:
    """(ranked rows with similarity, new rank and delta; attribution of the rows that are kept)."""
    flags = catalog.flags(collection)
    scoped = filters.scope(request.notebooks) if request.notebooks else None
    chunks = catalog.read(collection).where(filters.matching(source=request.source, scoped=scoped))
    asked = _asked(chunks, [request.question], embedder, flags, rewrite if request.rewrite else same_question)
    rows = search.knn(chunks, asked, request.k, flags.space).join(chunks.select(*_RESULT), "id").withColumn("similarity", search.similarity(F.col("distance")))
    listed = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contents"))
    reply = order(F.lit(request.question), F.col("contents")) if request.rerank else F.lit(None).cast("string")
    rows = search.same_content_first(search.rerank(rows, listed.select("query_id", reply.alias("reply")), "query_id"), "query_id", [*_RESULT, "distance", "similarity"])
    kept = rows.where(F.col("new_rank") <= request.final_k) if request.final_k else rows
    return kept.orderBy("new_rank"), search.attribution(kept.withColumn("rank", F.col("new_rank")), ["query_id"]).drop("query_id")


@dataclass
class _Kept:
    version: int
    until: float
    rows: DataFrame


class Snapshots:
    """Rollups of collections, kept until the collection changes or their time is over."""

    def __init__(self, catalog: Catalog, seconds: float = 60.0):
        self.catalog, self.seconds = catalog, seconds
        self._kept: dict[str, _Kept] = {}

    def sources(self, collection: str) -> DataFrame:
        version = self.catalog.entry(collection)["version"]
        kept = self._kept.get(collection)
        if kept is None or kept.version != version or kept.until < time.monotonic():
            self.forget(collection)
            kept = self._kept[collection] = _Kept(version, time.monotonic() + self.seconds, rollup.by_source(self.catalog.read(collection)).persist())
        return kept.rows

    def notebook(self, collection: str, notebook: str) -> DataFrame:
        """One row of sums; a notebook that holds nothing has zeros."""
        rows = self.sources(collection).where(F.col("notebook") == notebook)
        return rows.agg(F.lit(notebook).alias("notebook"), F.count("*").alias("sources"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "chars", "bytes")))

    def forget(self, collection: str) -> None:
        if kept := self._kept.pop(collection, None):
            kept.rows.unpersist()
