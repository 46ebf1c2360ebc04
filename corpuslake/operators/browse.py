"""Paging through a collection and looking at single chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.vectors import stored_dimensions


def chunk_view(chunks: DataFrame, full: bool = False, chars: int = 400) -> DataFrame:
    """A chunk as it is shown: sizes, the text or its beginning, and the names with blanks for nulls."""
    c = F.coalesce("content", F.lit(""))
    text = c if full else F.substring(c, 1, chars)
    blank = lambda n: F.coalesce(n, F.lit("")).alias(n)
    return chunks.select("id", blank("notebook_id"), blank("source_id"), blank("source"), "chunk_index", "page_start", "page_end", F.length(c).alias("chars"), F.octet_length(c).alias("bytes"), text.alias("preview"), (F.lit(not full) & (F.length(c) > chars)).alias("truncated"), "seq")


def page(chunks: DataFrame, condition: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in order of seq, with the number of all matching rows and whether more follow."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset 0 or more")
    rows = chunks.where(condition)
    shown = chunk_view(rows).orderBy("seq").offset(offset).limit(limit)
    return shown.withColumn("total", rows.agg(F.count("*")).scalar()).withColumn("has_more", F.col("total") > offset + limit)


def lookup(chunks: DataFrame, vectors: DataFrame, condition: Column) -> DataFrame:
    """Single chunks with the size of their stored vectors, 0 rows where nothing fits or no vector is stored; of an id delivered twice one vector counts."""
    stored = vectors.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("embedding").alias("embedding"))
    return chunks.where(condition).join(stored, "id").withColumn("dims", stored_dimensions(F.col("embedding"))).drop("embedding")


def result_rows(rows: DataFrame) -> DataFrame:
    """Search results with missing names as blanks, a blank notebook as null and whole-number pages."""
    return rows.select("id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.nullif("notebook_id", F.lit("")).alias("notebook_id"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"))
