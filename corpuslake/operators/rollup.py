"""Rollups over a whole collection, each in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_NOTEBOOK, NO_SOURCE = "(no notebookId)", "(no sourceId)"


def tally() -> list[Column]:
    """Chunks, characters, bytes and sizes of the contents; a null content is an empty one."""
    c = F.coalesce("content", F.lit(""))
    n = F.length(c)
    return [F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.sum(F.octet_length(c)).alias("bytes"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.sum(n) / F.count("*"), 1).alias("avg_chars")]


def _keyed(chunks: DataFrame) -> DataFrame:
    name = F.coalesce("source", F.lit(""))
    source = F.nullif("source_id", F.lit(""))
    return chunks.withColumn("notebook", F.coalesce(F.nullif("notebook_id", F.lit("")), F.lit(NO_NOTEBOOK))).withColumn("source_key", F.coalesce(source, F.concat(F.lit(NO_SOURCE), name)))


def by_source(chunks: DataFrame) -> DataFrame:
    """(notebook, source_key): tally, first name and first id in order of seq; position orders the sources of a notebook."""
    rows = _keyed(chunks).groupBy("notebook", "source_key").agg(
        *tally(),
        F.min_by("source", F.when(F.nullif("source", F.lit("")).isNotNull(), F.col("seq"))).alias("source"),
        F.min_by("id", "seq").alias("sample_id"),
        F.min("seq").alias("first_seq"),
    )
    order = Window.partitionBy("notebook").orderBy(F.desc("chunks"), "first_seq")
    return rows.withColumn("position", F.row_number().over(order))


def by_notebook(chunks: DataFrame) -> DataFrame:
    rows = _keyed(chunks).groupBy("notebook").agg(*tally(), F.count_distinct("source_key").alias("sources"), F.min("seq").alias("first_seq"))
    return rows


def totals(chunks: DataFrame) -> DataFrame:
    """One row; a source that stands in two notebooks counts twice."""
    rows = _keyed(chunks)
    pairs = F.count_distinct(F.struct("notebook", "source_key")).alias("sources")
    return rows.agg(*tally(), F.count_if(F.col("notebook") == NO_NOTEBOOK).alias("chunks_without_notebook"), pairs, F.count_distinct("notebook").alias("notebooks"))


def levels(chunks: DataFrame) -> DataFrame:
    """Sources, notebooks and the whole in one pass; level is 0, 1 and 3."""
    rows = _keyed(chunks)
    return rows.groupingSets([[F.col("notebook"), F.col("source_key")], [F.col("notebook")], []], F.col("notebook"), F.col("source_key")).agg(*tally(), F.grouping_id().cast("int").alias("level"))


def counts_with_zeros(names: DataFrame, rows: DataFrame, on: str, count: str = "chunks") -> DataFrame:
    """Every name with its number of rows, 0 where there are none; null names match none."""
    by = rows.groupBy(on).agg(F.count("*").alias(count))
    return names.select(on).distinct().join(by, on, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def counts_with_total(rows: DataFrame, by: str, count: str, total: str = "(all)") -> DataFrame:
    """Rows of every name and of all together, in one scan; ``whole`` marks the total. Rows without a name count nowhere."""
    out = rows.where(F.col(by).isNotNull()).rollup(by).agg(F.count("*").alias(count), F.grouping(by).cast("int").alias("whole"))
    return out.withColumn(by, F.coalesce(by, F.lit(total)))


def members(rows: DataFrame, by: str, member: str, names: str, count: str) -> DataFrame:
    """(by, names, count): the different members of every group, sorted, and its rows; a null group is a group."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(member)).alias(names), F.count("*").alias(count))


def histogram(rows: DataFrame, by: str, count: str, **filled: str) -> DataFrame:
    """Rows by the values of a column; each further name counts those whose named column isn't null."""
    return rows.groupBy(by).agg(F.count("*").alias(count), *(F.count(c).alias(name) for name, c in filled.items()))


def metadata_map(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(collection_id, metadata): key-value rows as a map, the first filled one of their four value columns as text; names without rows get an empty map."""
    value = F.coalesce("str_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    pairs = rows.where("key is not null").groupBy("collection_id", "key").agg(F.max(value).alias("value"))
    maps = pairs.groupBy("collection_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    return names.join(maps, "collection_id", "left").withColumn("metadata", F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")))


def usage(calls: DataFrame, price_in: float, price_out: float, group: list[str]) -> DataFrame:
    """Calls, failures, tokens and cost in USD; prices are per million tokens, null tokens count as none."""
    tin, tout = F.sum(F.coalesce("prompt_tokens", F.lit(0))), F.sum(F.coalesce("completion_tokens", F.lit(0)))
    failed = F.count_if(F.coalesce(F.col("finish_reason") == "error", F.lit(False)))
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), failed.alias("failures"), tin.alias("prompt_tokens"), tout.alias("completion_tokens"), F.round((tin * price_in + tout * price_out) / 1e6, 4).alias("usd"))
