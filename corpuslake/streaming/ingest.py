"""Page texts as a stream: every micro-batch is an upsert, so a batch that is given again changes nothing.

The reference has no streams; this carries its idempotent page ingest over to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuslake.plans.catalog import Catalog
from corpuslake.plans.ingest import store_pages
from corpuslake.plans.providers import Embedder


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def ingest(pages: DataFrame, catalog: Catalog, name: str, embedder: Embedder, checkpoint: str) -> DataStreamWriter:
    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        if not rows.isEmpty():
            store_pages(catalog, name, rows, embedder)
        rows.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def arrivals(pages: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Pages and characters a window of arrival; what comes later than ``late`` is left out."""
    return pages.withWatermark("received_at", late).groupBy(F.window("received_at", window)).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
