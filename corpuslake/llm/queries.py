"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import encodings, leakage, line_quality, long_spans, mixing, neighbours, scan_noise, tree_split, truncation, visual_form
from corpuslake.session import cut_lineage, read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.defects(read_table(spark, d, "extracted_pages"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repair(read_table(spark, d, "extracted_pages"))


def _p2_tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str, str | None]]:
    return [
        ("page_text", read_table(spark, d, "page_text"), "row_id", "text", None),
        ("chunks", read_table(spark, d, "chunks"), "id", "content", "seq"),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.look_alike_pairs(_p2_tables(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.look_alike_classes(_p2_tables(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.forms_of_tables(_p2_tables(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_split.split_oversized(read_table(spark, d, "chunks")).select("id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return tree_split.split_oversized(read_table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read_table(spark, d, "vision_results")).where("is_cut").select("result_id")


def p4_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(truncation.truncated(read_table(spark, d, "vision_results")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual_pairs(read_table(spark, d, "chunk_vectors")).select("id_a", "id_b")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_lists(read_table(spark, d, "chunk_vectors"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    quality = line_quality.line_quality(read_table(spark, d, "page_text"))
    return line_quality.not_prose(quality).select(F.col("key").alias("row_id"))


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    quality = line_quality.line_quality(read_table(spark, d, "page_text")).withColumnRenamed("key", "row_id")
    graded = read_table(spark, d, "text_quality").where("row_id is not null").groupBy("row_id")
    return quality.join(graded.agg(F.max_by(F.struct("status", "stats"), F.struct("graded_at", "status")).alias("recorded")), "row_id", "left").select(*quality.columns, F.col("recorded.status").alias("recorded_status"), F.col("recorded.stats").alias("recorded_stats"))


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_records([
        ("page_text", read_table(spark, d, "page_text"), "row_id", "text"),
        ("extracted_pages", read_table(spark, d, "extracted_pages"), "extract_id", "text"),
    ])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).select("table_name", "record_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind = 'verbatim' and longest_run >= 12").select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.contaminated(_leaks(spark, d), read_table(spark, d, "eval_items"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind = 'paraphrase'").select("doc_id", "item_id", "similarity")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_targets")
    return mixing.reached_shares(cut_lineage(p9_mix(spark, d)), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    spans = long_spans.shared_spans(read_table(spark, d, "documents"))
    return spans.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b")).distinct()


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return long_spans.shared_part(docs, cut_lineage(long_spans.shared_spans(docs)))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


P3_FOUND = """SELECT id FROM (SELECT id, arg_max(content, seq) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id) WHERE length(content) > 2000"""

P5_FOUND = """WITH v AS (SELECT id, max(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE id IS NOT NULL AND len(embedding) = 64 GROUP BY id),
    f AS (SELECT id, e FROM v WHERE list_dot_product(e, e) > 0),
    d AS (SELECT a.id AS a, b.id AS b, list_cosine_distance(a.e, b.e) AS d FROM f a, f b WHERE a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS n FROM d)
    SELECT x.a AS id_a, x.b AS id_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.n <= 5 AND y.n <= 5 AND x.d <= 0.03 AND x.a < x.b"""

P8_FOUND = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

P10_FOUND = """WITH s AS (SELECT DISTINCT doc_id, page_id, substr(text, k, 200) AS t FROM (SELECT doc_id, page_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200))
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b USING (t) WHERE a.doc_id < b.doc_id AND a.page_id IS DISTINCT FROM b.page_id"""


P8_ITEMS = f"SELECT i.item_id, i.benchmark, count(DISTINCT l.doc_id) AS documents FROM eval_items i JOIN ({P8_FOUND}) l ON l.item_id = i.item_id GROUP BY i.item_id, i.benchmark"


def oracle_sql() -> dict[str, str]:
    return {"p8_leaked_items": P8_ITEMS, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p8_found": P8_FOUND, "p10_found": P10_FOUND}
