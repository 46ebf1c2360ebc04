"""Changes of a collection as plans: what its rows are after an upsert, a move, a copy or a deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import clean_text
from corpuslake.functions.vectors import l2_normalize
from corpuslake.operators.chunking import chunked
from corpuslake.operators.filters import without
from corpuslake.operators.pages import merge_pages
from corpuslake.plans.catalog import Catalog, ConflictError
from corpuslake.plans.providers import DOCUMENT, Embedder
from corpuslake.plans.requests import MOST_NOTEBOOKS, IngestText


def latest(rows: DataFrame, key: str = "id", version: str = "seq") -> DataFrame:
    """Of each key the row with the highest version; rows with a null key are left out."""
    columns = rows.columns
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("r"))
    return best.select(*(F.col(f"r.{c}").alias(c) for c in columns))


def foreign_owners(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(source_id, owners): other notebooks that hold chunks of an arriving source."""
    who = arriving.select("source_id", F.col("notebook_id").alias("target")).distinct()
    other = stored.join(who, "source_id").where((F.coalesce("notebook_id", F.lit("")) != "") & ~F.col("notebook_id").eqNullSafe(F.col("target")))
    return other.groupBy("source_id").agg(F.array_sort(F.collect_set("notebook_id")).alias("owners"))


def upserted(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """The rows after all chunks of the arriving sources were replaced; chunks that fell away are gone."""
    return stored.join(arriving.select("source_id").distinct(), "source_id", "left_anti").unionByName(arriving, allowMissingColumns=True)


def stale(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Stored chunks of arriving sources whose ids don't come again."""
    return stored.join(arriving.select("source_id").distinct(), "source_id", "left_semi").join(arriving.select("id"), "id", "left_anti")


def orphans(names: DataFrame, rows: DataFrame, key: str = "source_id") -> DataFrame:
    """The different keys of ``names`` for which ``rows`` holds nothing; a null key is one of them."""
    return names.select(key).distinct().join(rows.select(key), key, "left_anti")


def delete_ids(stored: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number deleted)."""
    asked = ids.select("id").where("id is not null").distinct()
    return stored.join(asked, "id", "left_anti"), stored.join(asked, "id", "left_semi").agg(F.count("*").alias("deleted"))


def delete_where(stored: DataFrame, condition: Column) -> DataFrame:
    return without(stored, condition)


def moved(source: DataFrame, target: DataFrame, notebooks: Sequence[str], normalized: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source after, target after, notebook_id and chunks moved); notebooks that hold nothing report 0."""
    names = [n for n in dict.fromkeys(n.strip() for n in notebooks) if n]
    if len(names) > MOST_NOTEBOOKS:
        raise ValueError(f"at most {MOST_NOTEBOOKS} notebooks")  # they are sent to every task
    wanted = source.sparkSession.createDataFrame([(n,) for n in names], "notebook_id string")
    going = source.join(F.broadcast(wanted), "notebook_id", "left_semi")
    if normalized:
        going = going.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
    counts = going.groupBy("notebook_id").agg(F.count("*").alias("chunks"))
    report = wanted.join(counts, "notebook_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    kept = target.join(going.select("id"), "id", "left_anti")
    return source.join(F.broadcast(wanted), "notebook_id", "left_anti"), kept.unionByName(going, allowMissingColumns=True), report


def to_embed(source: DataFrame, target: DataFrame) -> DataFrame:
    """Chunks that a copy still has to embed: not in the target yet and not empty; running it again after a break goes on."""
    return source.where(F.coalesce("content", F.lit("")) != "").join(target.select("id"), "id", "left_anti")


def in_order_of_writing(chunks: DataFrame, version: int) -> DataFrame:
    """Adds seq: later versions after earlier ones, within a version by source and chunk; no two rows have one.

    The rows are sorted over all partitions, so a partition's number and the place in it tell
    the order, and nothing has to be counted first.
    """
    rows = chunks.orderBy("source_id", "chunk_index", "id")
    place = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    seq = F.shiftleft(F.lit(version).cast("bigint"), 46) + F.shiftleft(F.shiftright(place, 33), 28) + place.bitwiseAND(F.lit((1 << 28) - 1))
    return rows.withColumn("seq", seq)


def store_pages(catalog: Catalog, name: str, pages: DataFrame, embedder: Embedder, replies: DataFrame | None = None) -> int:
    """Page texts (source_id, notebook_id, source, page, ord, text, row_id) cleaned, merged, chunked, embedded and upserted; returns the new version.

    The collection's flags name the chunker, tell whether vectors are normalised and whether
    the embedder is told that these are documents. ``replies`` are those of a model to the
    sections, for the smart chunker.
    """
    flags, version = catalog.flags(name), catalog.entry(name)["version"]
    cleaned = pages.withColumn("text", clean_text(F.col("text")))
    chunks = chunked(merge_pages(cleaned), flags.chunker, replies)
    stored = catalog.read(name)
    if not (owners := foreign_owners(stored, chunks).limit(1)).isEmpty():
        raise ConflictError(f"a source belongs to other notebooks: {owners.first().asDict()}")
    arriving = in_order_of_writing(embedder.embed(chunks, "content", flags.normalized, DOCUMENT if flags.task_types else None), version + 1)
    return catalog.write(name, upserted(stored, arriving), version)


def store_request(catalog: Catalog, name: str, request: IngestText, embedder: Embedder) -> int:
    """The pages of one checked request stored as one source of one notebook."""
    rows = [(i, request.source, request.notebook, request.source, page, 0, text) for i, (page, text) in enumerate(request.pages)]
    pages = catalog.spark.createDataFrame(rows, "row_id bigint, source_id string, notebook_id string, source string, page int, ord int, text string")
    return store_pages(catalog, name, pages, embedder)


def copy_missing(catalog: Catalog, source: str, target: str, embedder: Embedder) -> dict[str, int]:
    """Embeds what of ``source`` is not in ``target`` yet; scanned, embedded and skipped are counted. A second run embeds nothing."""
    if source == target:
        raise ValueError("source and target are the same collection")
    have, rows = catalog.read(target), catalog.read(source)
    new = to_embed(rows, have)
    scanned, embedded = rows.count(), new.count()
    if embedded:
        flags = catalog.flags(target)
        catalog.write(target, have.unionByName(embedder.embed(new, "content", flags.normalized, DOCUMENT if flags.task_types else None)))
    return {"scanned": scanned, "embedded": embedded, "skipped": scanned - embedded}
