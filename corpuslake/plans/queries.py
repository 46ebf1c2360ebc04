"""Queries over the test tables, one or more per operator, and SQL that gives the same rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.functions import vectors as V
from corpuslake.operators import browse, chunking, filters, pages, rollup, search
from corpuslake.plans import ingest
from corpuslake.plans.providers import lexical_order
from corpuslake.session import read_table
from corpuslake.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_read = read_table

CURRENT = "cur AS (SELECT c.* FROM chunks c JOIN (SELECT id, max(seq) AS seq FROM chunks WHERE id IS NOT NULL GROUP BY id) m USING (id, seq))"
SPACE_SQL = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _current(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest(_read(spark, d, "chunks"))


# Nearest neighbours: every embedding whose id is divisible by 20 against all.


def _knn(space: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _read(spark, d, "embeddings")
        hits = search.knn(e, e.where("vec_id % 20 = 0"), 10, space, key="vec_id")
        return hits.select("query_id", "rank", "id", (F.round("distance", 5) + 0.0).alias("distance"))

    return run


def _knn_sql(expr: str, where: str = "true", drop: str = "true") -> str:
    return f"""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
    b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {expr} AS distance FROM q, b WHERE {where} AND {drop}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
    SELECT query_id, rank, id, round(distance, 5) + 0.0 AS distance FROM r WHERE rank <= 10"""


for _space, _expr in (("cosine", "list_cosine_distance(q.v, b.v)"), ("ip", "1 - list_dot_product(q.v, b.v)"), ("l2", "list_distance(q.v, b.v) ** 2")):
    query(f"knn_{_space}", _knn_sql(_expr))(_knn(_space))


@query("similar_chunks", _knn_sql("list_cosine_distance(q.v, b.v)", "q.label = b.label", "q.vec_id <> b.vec_id"))
def similar_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    hits = search.knn(e, e.where("vec_id % 20 = 0"), 10, "cosine", key="vec_id", same="label", drop_self=True)
    return hits.select("query_id", "rank", "id", (F.round("distance", 5) + 0.0).alias("distance"))


@query("knn_filtered", _knn_sql("list_cosine_distance(q.v, b.v)", "b.label IN (1, 2, 3)"))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    hits = search.knn(e.where(filters.field_in("label", [1, 2, 3])), e.where("vec_id % 20 = 0"), 10, "cosine", key="vec_id")
    return hits.select("query_id", "rank", "id", (F.round("distance", 5) + 0.0).alias("distance"))


@query("knn_traced", _knn_sql("list_cosine_distance(q.v, b.v)").replace("round(distance, 5) + 0.0 AS distance", "round(1 - distance, 6) AS similarity"))
def knn_traced(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    hits = search.knn(e, e.where("vec_id % 20 = 0"), 10, "cosine", key="vec_id")
    return hits.select("query_id", "rank", "id", search.similarity(F.col("distance")).alias("similarity"))


@query("l2_normalized", "SELECT vec_id, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: 0.5 * x / sqrt(list_dot_product(list_transform(embedding::DOUBLE[], lambda y: 0.5 * y), list_transform(embedding::DOUBLE[], lambda y: 0.5 * y)))), 'sum'), 6) AS total, len(embedding) AS dims FROM embeddings")
def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings").withColumn("v", V.l2_normalize(F.transform(V.as_double(F.col("embedding")), lambda x: 0.5 * x)))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), V.stored_dimensions(F.col("embedding")).cast("bigint").alias("dims"))


_WORDS = ["river", "bridge", "lumière", "garten", "montaña", "museum", "planet"]


@query("vocabulary_embedding", "SELECT doc_id, " + ", ".join(f"0.01::DOUBLE + 3::DOUBLE * len(regexp_extract_all(lower(coalesce(text, '')), '{w}')) AS w{i}" for i, w in enumerate(_WORDS)) + " FROM documents")
def vocabulary_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = V.vocabulary_embedding(F.col("text"), _WORDS)
    return _read(spark, d, "documents").withColumn("v", v).select("doc_id", *(F.col("v")[i].alias(f"w{i}") for i in range(len(_WORDS))))


# Merging and ranking recorded results: the queries of one source are the queries of one request.

_LISTS = """lists AS (SELECT regexp_extract(query_id, '^(src_[0-9a-f]+)', 1) AS request, query_id, rank_no AS rank, min(id) AS id, min(distance) AS distance FROM similar_log GROUP BY query_id, rank_no)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "similar_log").groupBy("query_id", "rank_no").agg(F.min("id").alias("id"), F.min("distance").alias("distance"))
    return rows.select(F.regexp_extract("query_id", "^(src_[0-9a-f]+)", 1).alias("request"), "query_id", F.col("rank_no").alias("rank"), "id", "distance")


@query("multi_query_round_robin", f"""WITH {_LISTS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY request ORDER BY query_id) AS qi FROM lists),
    g AS (SELECT request, id, min((rank, qi)) AS place, min(distance) AS distance FROM n GROUP BY request, id),
    p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY place, id) AS position FROM g)
    SELECT request, position, id, distance FROM p WHERE position <= 10""")
def multi_query_round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d).withColumn("query_index", F.dense_rank().over(Window.partitionBy("request").orderBy("query_id"))).withColumn("content", F.lit(""))
    return search.merge_round_robin(rows, ["request"], 10).select("request", "position", "id", "distance")


@query("rerank_apply", f"""WITH {_LISTS}, n AS (SELECT query_id, max(rank) AS m FROM lists GROUP BY query_id),
    o AS (SELECT query_id, unnest([m, 2, 2, 99]) AS r, generate_subscripts([m, 2, 2, 99], 1) AS place FROM n),
    f AS (SELECT query_id, r, min(place) AS place FROM o GROUP BY query_id, r),
    j AS (SELECT l.*, f.place FROM lists l LEFT JOIN f ON f.query_id = l.query_id AND f.r = l.rank),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, rank) AS new_rank FROM j)
    SELECT query_id, rank, id, new_rank, rank - new_rank AS delta FROM k""")
def rerank_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d)
    replies = rows.groupBy("query_id").agg(F.concat(F.lit('{"order":['), F.max("rank").cast("string"), F.lit(",2,2,99]}")).alias("reply"))
    return search.rerank(rows, replies, "query_id").select("query_id", "rank", "id", "new_rank", "delta")


_WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query("lexical_rerank", f"""WITH {_LISTS}, {CURRENT}, j AS (SELECT l.query_id, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank, c.content) AS n, {_WORDS_SQL.format('c.content')} AS cw, {_WORDS_SQL.format('q.content')} AS qw FROM lists l JOIN cur c ON c.id = l.id JOIN cur q ON q.id = l.query_id)
    SELECT query_id, '{{"order":[' || string_agg(n, ',' ORDER BY len(list_intersect(cw, qw)) DESC, n) || ']}}' AS reply FROM j GROUP BY query_id""")
def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d).join(_current(spark, d).select("id", "content"), "id")
    asked = _current(spark, d).select(F.col("id").alias("query_id"), F.col("content").alias("question"))
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contents"))
    return lists.join(asked, "query_id").select("query_id", lexical_order(F.col("question"), F.col("contents")).alias("reply"))


@query("attribution", f"""WITH {_LISTS}, {CURRENT},
    r AS (SELECT l.request, l.id, min(l.rank) AS rank, min(l.distance) AS distance FROM lists l GROUP BY l.request, l.id),
    o AS (SELECT request, id, distance, row_number() OVER (PARTITION BY request ORDER BY rank, id) AS rank FROM r),
    j AS (SELECT o.*, coalesce(nullif(c.source_id, ''), nullif(c.source, ''), '(unknown)') AS label FROM o LEFT JOIN cur c USING (id)),
    g AS (SELECT request, label, count(*) AS chunks, min(distance) AS best_distance, arg_min(id, rank) AS first_id, min(rank) AS first_rank FROM j GROUP BY request, label)
    SELECT *, row_number() OVER (PARTITION BY request ORDER BY chunks DESC, first_rank) AS position FROM g""")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d).groupBy("request", "id").agg(F.min("rank").alias("rank"), F.min("distance").alias("distance"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("rank", "id"))).join(_current(spark, d).select("id", "source_id", "source"), "id", "left")
    return search.attribution(rows, ["request"])


@query("merge_dedupe", """WITH p AS (SELECT content, seq FROM chunks WHERE chunk_index IS NOT NULL), s AS (SELECT content, min(seq) AS seq FROM chunks WHERE chunk_index IS NULL GROUP BY content)
    SELECT seq, 0 AS part, length(content) AS chars FROM p UNION ALL SELECT seq, 1, length(content) FROM s WHERE content NOT IN (SELECT content FROM p WHERE content IS NOT NULL)""")
def merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "chunks").select("content", "seq", "chunk_index")
    out = search.merge_dedupe(c.where("chunk_index is not null").drop("chunk_index"), c.where("chunk_index is null").drop("chunk_index"))
    return out.select("seq", "part", F.length("content").cast("bigint").alias("chars"))


@query("history_last6", """WITH r AS (SELECT source_id, kind, text, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, result_id DESC) AS back FROM vision_results WHERE source_id IS NOT NULL),
    t AS (SELECT source_id, upper(substr(kind, 1, 1)) || lower(substr(kind, 2)) || ': ' || coalesce(text, '') AS line, back FROM r WHERE back <= 6)
    SELECT source_id, md5(string_agg(line, chr(10) ORDER BY back DESC)) AS history FROM t GROUP BY source_id""")
def history_last6(spark: SparkSession, d: str) -> DataFrame:
    turns = _read(spark, d, "vision_results").where("source_id is not null").select("source_id", F.col("kind").alias("role"), F.col("text").alias("content"), "created_at", "result_id")
    return search.last_turns(turns, "source_id", ["created_at", "result_id"]).select("source_id", F.md5(T.history_text(F.col("turns"))).alias("history"))


# Rollups and browsing.

_KEYED = "k AS (SELECT *, coalesce(nullif(notebook_id, ''), '(no notebookId)') AS notebook, coalesce(nullif(source_id, ''), '(no sourceId)' || coalesce(source, '')) AS source_key, length(coalesce(content, '')) AS n FROM cur)"
_TALLY = "count(*) AS chunks, sum(n)::BIGINT AS chars, sum(strlen(coalesce(content, '')))::BIGINT AS bytes, min(n) AS min_chars, max(n) AS max_chars, round(sum(n) / count(*), 1) AS avg_chars"


def _as_long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


@query("snapshot_sources", f"""WITH {CURRENT}, {_KEYED}, g AS (SELECT notebook, source_key, {_TALLY}, arg_min(source, seq) FILTER (WHERE nullif(source, '') IS NOT NULL) AS source, arg_min(id, seq) AS sample_id, min(seq) AS first_seq FROM k GROUP BY notebook, source_key)
    SELECT *, row_number() OVER (PARTITION BY notebook ORDER BY chunks DESC, first_seq) AS position FROM g""")
def snapshot_sources(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(rollup.by_source(_current(spark, d)))


@query("snapshot_notebooks", f"WITH {CURRENT}, {_KEYED} SELECT notebook, {_TALLY}, count(DISTINCT source_key) AS sources, min(seq) AS first_seq FROM k GROUP BY notebook")
def snapshot_notebooks(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(rollup.by_notebook(_current(spark, d)))


@query("snapshot_totals", f"WITH {CURRENT}, {_KEYED} SELECT {_TALLY}, count(*) FILTER (WHERE notebook = '(no notebookId)') AS chunks_without_notebook, count(DISTINCT (notebook, source_key)) AS sources, count(DISTINCT notebook) AS notebooks FROM k")
def snapshot_totals(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(rollup.totals(_current(spark, d)))


@query("snapshot_levels", f"WITH {CURRENT}, {_KEYED} SELECT notebook, source_key, {_TALLY}, grouping(notebook, source_key)::BIGINT AS level FROM k GROUP BY GROUPING SETS ((notebook, source_key), (notebook), ())")
def snapshot_levels(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(rollup.levels(_current(spark, d)))


@query("chunk_view", """SELECT id, coalesce(notebook_id, '') AS notebook_id, coalesce(source_id, '') AS source_id, coalesce(source, '') AS source, chunk_index, page_start, page_end, length(coalesce(content, '')) AS chars, strlen(coalesce(content, '')) AS bytes, md5(substr(coalesce(content, ''), 1, 400)) AS preview, length(coalesce(content, '')) > 400 AS truncated, seq FROM chunks""")
def chunk_view(spark: SparkSession, d: str) -> DataFrame:
    rows = browse.chunk_view(_read(spark, d, "chunks")).withColumn("preview", F.md5("preview"))
    return rows.withColumn("chars", F.col("chars").cast("bigint")).withColumn("bytes", F.col("bytes").cast("bigint"))


@query("browse_contains_page", """WITH m AS (SELECT id, seq, length(content) AS chars FROM chunks WHERE contains(content, 'river')), t AS (SELECT count(*) AS total FROM m)
    SELECT id, seq, chars, total, total > 55 AS has_more FROM (SELECT * FROM m ORDER BY seq LIMIT 50 OFFSET 5), t""")
def browse_contains_page(spark: SparkSession, d: str) -> DataFrame:
    rows = browse.page(_read(spark, d, "chunks"), filters.matching(contains="river"), 50, 5)
    return rows.select("id", "seq", F.col("chars").cast("bigint").alias("chars"), "total", "has_more")


@query("point_lookup", "SELECT c.id, c.seq, len(v.embedding) AS dims FROM chunks c JOIN (SELECT id, max(embedding) AS embedding FROM chunk_vectors GROUP BY id) v USING (id) WHERE c.seq = 1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return browse.lookup(_read(spark, d, "chunks"), _read(spark, d, "chunk_vectors"), F.col("seq") == 1).select("id", "seq", F.col("dims").cast("bigint").alias("dims"))


@query("scope_or", f"WITH {CURRENT} SELECT id, notebook_id, source_id FROM cur WHERE notebook_id IN ('nb_shared_library') OR source_id IN (SELECT min(source_id) FROM sources)")
def scope_or(spark: SparkSession, d: str) -> DataFrame:
    first = _read(spark, d, "sources").agg(F.min("source_id")).scalar()
    return _current(spark, d).where(filters.scope(["nb_shared_library"], [first])).select("id", "notebook_id", "source_id")


@query("filtered_count", "SELECT count(*) AS chunks FROM chunks WHERE notebook_id = 'nb_shared_library' AND contains(content, 'the')")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "chunks").where(filters.matching(notebook="nb_shared_library", contains="the")).agg(F.count("*").alias("chunks"))


@query("result_rows", "SELECT id, md5(coalesce(content, '')) AS content, coalesce(source, '') AS source, coalesce(source_id, '') AS source_id, nullif(notebook_id, '') AS notebook_id, page_start, page_end FROM chunks")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    return browse.result_rows(_read(spark, d, "chunks")).withColumn("content", F.md5("content"))


@query("tenant_scope", """SELECT source_id, collection, CASE WHEN collection = 'lessons_docs_768' OR starts_with(collection, 'lessons_docs_768__') THEN 'lessons' WHEN collection = 'library_docs' OR starts_with(collection, 'library_docs__') THEN 'library' END AS tenant, regexp_matches(collection, '^[A-Za-z0-9][A-Za-z0-9_-]{1,61}[A-Za-z0-9]$') AS valid FROM sources""")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    live = [("library", "library_docs"), ("lessons", "lessons_docs_768")]
    return _read(spark, d, "sources").select("source_id", "collection", filters.tenant_of(F.col("collection"), live).alias("tenant"), T.is_collection_name(F.col("collection")).alias("valid"))


@query("collection_counts", """SELECT n.collection, count(c.source_id) AS chunks FROM (SELECT DISTINCT collection FROM sources) n
    LEFT JOIN (SELECT s.collection, c.source_id FROM chunks c JOIN (SELECT DISTINCT source_id, collection FROM sources) s USING (source_id)) c ON c.collection = n.collection GROUP BY n.collection""")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "sources").select("source_id", "collection").distinct()
    return rollup.counts_with_zeros(s, _read(spark, d, "chunks").join(s, "source_id"), "collection")


@query("collection_segments", "SELECT collection, to_json(list_sort(list(DISTINCT notebook_id) FILTER (WHERE notebook_id IS NOT NULL))) AS notebooks, count(*) AS sources FROM sources GROUP BY collection")
def collection_segments(spark: SparkSession, d: str) -> DataFrame:
    return rollup.members(_read(spark, d, "sources"), "collection", "notebook_id", "notebooks", "sources").withColumn("notebooks", F.to_json("notebooks"))


@query("health_counts", "SELECT coalesce(collection, '(all)') AS collection, count(*) AS sources, grouping(collection)::INT AS whole FROM sources WHERE collection IS NOT NULL GROUP BY ROLLUP (collection)")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.counts_with_total(_read(spark, d, "sources"), "collection", "sources")


@query("metadata_map", """SELECT source_id AS collection_id, file_name, CAST(page_count AS VARCHAR) AS page_count, lang FROM sources""")
def metadata_map(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "sources").withColumnRenamed("source_id", "collection_id")
    value = lambda k, kind, c: s.select("collection_id", F.lit(k).alias("key"), *((F.col(c) if n == kind else F.lit(None).cast(t)).alias(f"{n}_value") for n, t in (("str", "string"), ("int", "int"), ("float", "double"), ("bool", "boolean"))))
    eav = value("file_name", "str", "file_name").unionByName(value("page_count", "int", "page_count")).unionByName(value("lang", "str", "lang"))
    rows = rollup.metadata_map(eav, s.select("collection_id"))
    return rows.select("collection_id", *(F.element_at("metadata", k).alias(k) for k in ("file_name", "page_count", "lang")))


@query("orphans", "SELECT DISTINCT source_id FROM page_text WHERE source_id NOT IN (SELECT source_id FROM chunks WHERE source_id IS NOT NULL)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return ingest.orphans(_read(spark, d, "page_text"), _read(spark, d, "chunks"))


@query("usage_cost", """SELECT kind, count(*) AS calls, count(*) FILTER (WHERE finish_reason = 'error') AS failures, sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS completion_tokens,
    round((sum(coalesce(prompt_tokens, 0)) * 0.3::DOUBLE + sum(coalesce(completion_tokens, 0)) * 1.2::DOUBLE) / 1e6, 4) AS usd FROM vision_results GROUP BY kind""")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    return rollup.usage(_read(spark, d, "vision_results"), 0.3, 1.2, ["kind"])


# Text.


# SQL of its own for the text functions: line by line and letter by letter where the functions use patterns.
_NL = "chr(10)"
_LINE_BLANKS = "' ' || chr(8232) || chr(8233)"
_PRESENTED = "{" + ", ".join(f"'{chr(i)}': '{unicodedata.normalize('NFKC', chr(i))}'" for r in (range(0xFB00, 0xFE00), range(0xFE70, 0xFEFF)) for i in r if unicodedata.normalize("NFKC", chr(i)) != chr(i)) + "}"


def _normal_sql(c: str) -> str:
    c = f"regexp_replace({c}, '\\r\\n?', {_NL}, 'g')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', ' ', 'g')"
    c = f"regexp_replace({c}, '[\\x{{AD}}\\x{{200B}}\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}\\x{{2066}}-\\x{{2069}}\\x{{FEFF}}]', '', 'g')"
    c = f"regexp_replace({c}, '[\\t \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')"
    c = f"array_to_string(list_transform(str_split({c}, {_NL}), lambda l: trim(l, {_LINE_BLANKS})), {_NL})"
    return f"trim(regexp_replace({c}, '\\n\\n\\n+', {_NL} || {_NL}, 'g'), {_LINE_BLANKS} || {_NL})"


def _clean_sql(c: str) -> str:
    folded = f"CASE WHEN regexp_matches({c}, '[\\x{{FB00}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFE}}]') THEN array_to_string(list_transform(str_split({c}, ''), lambda z: coalesce(element_at(presented.m, z)[1], z)), '') ELSE {c} END"
    return _normal_sql(f"replace(replace({folded}, chr(1600), ''), chr(65533), '')")


_WITH_PRESENTED = f"presented AS (SELECT MAP {_PRESENTED} AS m)"


@query("normalize_light", f"SELECT row_id, md5({_normal_sql('text')}) AS text FROM page_text")
def normalize_light(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "page_text").select("row_id", F.md5(T.normalize_light(F.col("text"))).alias("text"))


@query("clean_text", f"WITH {_WITH_PRESENTED} SELECT row_id, md5({_clean_sql('text')}) AS text FROM page_text, presented")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "page_text").select("row_id", F.md5(T.clean_text(F.col("text"))).alias("text"))


def _grade_sql(rows: str, key: str) -> str:
    """Common table expressions that end in ``graded``: the grade of the texts of ``rows`` (key, text)."""
    count = lambda p: f"length(regexp_replace(solid, '[^{p}]', '', 'g'))"
    odd = "\\x{A1}-\\x{A6}\\x{A8}\\x{AA}\\x{AC}\\x{AD}\\x{AF}\\x{B4}\\x{B6}\\x{B8}-\\x{BA}\\x{BF}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}\\x{152}\\x{153}\\x{160}\\x{161}\\x{178}\\x{17D}\\x{17E}\\x{192}\\x{2C6}\\x{2DC}\\x{2030}\\x{2039}\\x{203A}\\x{2020}\\x{2021}"
    arabic = "\\x{600}-\\x{6FF}\\x{750}-\\x{77F}\\x{8A0}-\\x{8FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFC}"
    control = "\\x00-\\x08\\x0E-\\x1B\\x7F-\\x{84}\\x{86}-\\x{9F}"
    return f"""{_WITH_PRESENTED}, raw AS (SELECT {key}, coalesce(text, '') AS raw FROM {rows}),
    solid AS (SELECT {key}, raw, regexp_replace(raw, '{SPACE_SQL}', '', 'g') AS solid, {_clean_sql('raw')} AS clean FROM raw, presented),
    counted AS (SELECT *, length(solid) AS n, {count(odd)} AS odd, {count(arabic)} AS arabic, {count(control)} AS control, {count("\\x{E000}-\\x{F8FF}")} AS private, {count("\\x{FFFD}")} AS lost,
        length(regexp_replace(regexp_replace(solid, '[{odd}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters,
        coalesce(list_sum(list_transform(regexp_extract_all(raw, '/(?:[A-Za-z]{{1,2}}[0-9+]{{1,6}}|uni[0-9A-Fa-f]{{4,6}})'), lambda g: length(g))), 0) AS glyph,
        length(regexp_replace(clean, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS readable,
        list_filter(list_transform(string_split_regex(clean, '\\s+'), lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g'))), lambda x: x > 0) AS words FROM solid),
    judged AS (SELECT *, len(list_filter(words, lambda x: x = 1)) AS single, array_to_string(list_filter([CASE WHEN n > 0 AND glyph / n >= 0.14995 THEN 'glyph-names' END, CASE WHEN n > 0 AND control / n >= 0.04995 THEN 'control-chars' END,
        CASE WHEN n > 0 AND private / n >= 0.09995 THEN 'private-use' END, CASE WHEN n > 0 AND odd / n >= 0.07995 AND arabic / n < 0.29995 THEN 'mojibake' END, CASE WHEN n > 0 AND lost / n >= 0.14995 THEN 'replacement-chars' END], lambda x: x IS NOT NULL), ',') AS damage FROM counted),
    graded AS (SELECT *, CASE WHEN damage <> '' OR (n > 0 AND letters / n < 0.29995) THEN 'junk' WHEN readable < 20 THEN 'empty' WHEN (n > 0 AND lost / n >= 0.01995) OR (len(words) >= 30 AND single / len(words) >= 0.49995) THEN 'degraded' ELSE 'ok' END AS status FROM judged)"""


@query("text_grade_shares", f"WITH {_grade_sql('page_text', 'row_id')} SELECT row_id, n AS chars, odd::BIGINT AS mojibake, arabic::BIGINT AS arabic, control::BIGINT AS control, private::BIGINT AS pua, lost::BIGINT AS fffd, letters::BIGINT AS letters, glyph::BIGINT AS glyph FROM graded")
def text_grade_shares(spark: SparkSession, d: str) -> DataFrame:
    g = T.grade(_read(spark, d, "page_text").select("row_id", "text"), "text", "g")
    # Shares of four digits tell the counts behind them, which round alike everywhere.
    return g.select("row_id", F.col("g.chars").cast("bigint").alias("chars"), *(F.round(F.col(f"g.{k}") * F.col("g.chars")).cast("bigint").alias(k) for k in ("mojibake", "arabic", "control", "pua", "fffd", "letters", "glyph")))


@query("text_grade", f"""WITH {_grade_sql('page_text', 'row_id')} SELECT row_id, status, CASE WHEN damage <> '' THEN damage WHEN status = 'junk' THEN 'few-letters' WHEN status = 'empty' THEN 'no-text'
    ELSE array_to_string(list_filter([CASE WHEN n > 0 AND lost / n >= 0.01995 THEN 'replacement-chars' END, CASE WHEN len(words) >= 30 AND single / len(words) >= 0.49995 THEN 'broken-words' END], lambda x: x IS NOT NULL), ',') END AS reasons,
    CASE WHEN status IN ('ok', 'degraded') THEN CASE WHEN len(words) > 0 THEN floor(100 * single / len(words) + 0.002)::BIGINT ELSE 0 END END AS single_percent FROM graded""")
def text_grade(spark: SparkSession, d: str) -> DataFrame:
    g = T.grade(_read(spark, d, "page_text").select("row_id", "text"), "text", "g")
    return g.select("row_id", "g.status", F.array_join("g.reasons", ",").alias("reasons"), F.floor(F.col("g.single_letter_words") * 100 + 0.002).alias("single_percent"))


@query("redact_url", "SELECT source_id, regexp_replace('https://files.example/' || coalesce(file_name, '') || '?page=1&token=' || source_id || '&key=' || source_id || '#top', '(?i)((?:[?&]|\\\\u0026)(?:token|access_token|key|sig|signature|x-goog-signature)=)[^&#\"''\\s\\\\]+', '\\1<redacted>', 'g') AS url FROM sources")
def redact_url(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://files.example/"), F.coalesce("file_name", F.lit("")), F.lit("?page=1&token="), "source_id", F.lit("&key="), "source_id", F.lit("#top"))
    return _read(spark, d, "sources").select("source_id", T.redact_url(url).alias("url"))


@query("redact_body", """SELECT row_id, '{"notebookId": ' || coalesce('"' || notebook_id || '"', 'null') || ', "sourceId": "' || source_id || '", "fileName": null, "collection": null, "pages": 1, "chars": ' || length(coalesce(text, '')) || '}' AS summary,
    '{"fileBase64": "<' || length(source_id) || ' base64 chars>", "u": "?key=<redacted>", "fileBase64":"<32 base64 chars>", "t": "' || repeat('x', page * 100) || '"}' AS whole FROM page_text WHERE source_id IS NOT NULL""")
def redact_body(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "page_text").where("source_id is not null")
    upload = F.to_json(F.struct(F.col("notebook_id").alias("notebookId"), F.col("source_id").alias("sourceId"), F.array(F.struct("text")).alias("pages")))
    other = F.concat(F.lit('{"fileBase64": "'), "source_id", F.lit('", "u": "?key='), "source_id", F.lit('", "fileBase64":"'), F.md5("source_id"), F.lit('", "t": "'), F.repeat(F.lit("x"), F.col("page") * 100), F.lit('"}'))
    return rows.select("row_id", T.redact_body(F.lit("/ingest/text"), upload).alias("summary"), T.redact_body(F.lit("/retrieve"), other, 1 << 30).alias("whole"))


@query("redact_cut", """SELECT row_id, substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN chr(10) || '... [truncated ' || (length(text) - 100) || ' more chars]' ELSE '' END AS cut FROM page_text WHERE text IS NOT NULL""")
def redact_cut(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "page_text").where("text is not null").select("row_id", T.redact_body(F.lit("/retrieve"), F.col("text"), 100).alias("cut"))


@query("human_bytes", """SELECT source_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size
    FROM (SELECT source_id, sum(strlen(coalesce(content, '')))::BIGINT * 37 AS b FROM chunks GROUP BY source_id)""")
def human_bytes(spark: SparkSession, d: str) -> DataFrame:
    b = _read(spark, d, "chunks").groupBy("source_id").agg((F.sum(F.octet_length(F.coalesce("content", F.lit("")))) * 37).alias("b"))
    return b.select("source_id", T.human_bytes(F.col("b")).alias("size"))


@query("disk_totals", "SELECT collection, sum(page_count)::BIGINT AS pages FROM sources GROUP BY collection ORDER BY pages DESC")
def disk_totals(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "sources").groupBy("collection").agg(F.sum("page_count").alias("pages")).orderBy(F.desc("pages"))


@query("json_leaves", "SELECT doc_id, array_to_string(list_filter([title, lang, source, edit_note, contributor], lambda x: trim(x) <> ''), chr(10)) AS text FROM documents")
def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    value = F.struct("doc_id", "title", F.struct(F.array("lang", "source").alias("where"), "edit_note").alias("inner"), "is_minor", "contributor")
    rows = _read(spark, d, "documents").select("doc_id", F.lit("x.json").alias("file_name"), F.encode(F.to_json(value), "utf-8").alias("content"))
    return files.extract_text(rows).select("doc_id", "text")


@query("json_entries", """SELECT source, 'אוניברסיטה: ' || source || chr(10) || 'תחום: ' || n || chr(10) || 'תנאי קבלה:' || chr(10) || '- ' || first || chr(10) || '- ' || last AS text
    FROM (SELECT source, count(*)::VARCHAR AS n, min(title) AS first, max(title) AS last FROM documents WHERE source IS NOT NULL AND title <> '' GROUP BY source)""")
def json_entries(spark: SparkSession, d: str) -> DataFrame:
    by = _read(spark, d, "documents").where("source is not null and title <> ''").groupBy("source").agg(F.count("*").cast("string").alias("major"), F.min("title").alias("first"), F.max("title").alias("last"))
    entry = F.struct("major", F.col("source").alias("university"), F.array("first", F.lit(""), "last").alias("requirements"))
    rows = by.select("source", F.lit("x.json").alias("file_name"), F.encode(F.to_json(F.struct(F.array(entry).alias("list"))), "utf-8").alias("content"))
    return files.extract_text(rows).select("source", "text")


@query("plain_text", "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.lit("a.MD").alias("file_name"), F.encode("text", "utf-8").alias("content"))
    return files.extract_text(rows).select("doc_id", F.md5("text").alias("text"))


@query("html_text", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_concat([coalesce(title, '')], str_split(translate(coalesce(text, ''), '<>&', '   '), {_NL})), lambda x: regexp_replace(regexp_replace(x, '^{SPACE_SQL}+', ''), '{SPACE_SQL}+$', '')), lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id, md5(array_to_string(lines, {_NL})) AS text FROM l""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.translate(F.coalesce("text", F.lit("")), "<>&", "   ")
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><style>b{}</style><script>if (1) {}</script></head><body><!-- x --><p>"), F.regexp_replace(text, "\\n", "</p><br/><p class='c'>"), F.lit("</p></body></html>"))
    rows = _read(spark, d, "documents").select("doc_id", F.lit("page.html").alias("file_name"), F.encode(page, "utf-8").alias("content"))
    return files.extract_text(rows).select("doc_id", F.md5("text").alias("text"))


@query("format_dispatch", "SELECT source_id, CASE WHEN regexp_matches(lower(coalesce(file_name, '')), '\\.[^.]+$') THEN regexp_extract(lower(file_name), '\\.([^.]+)$', 1) ELSE '' END AS extension FROM sources")
def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "sources").select("source_id", files.extension(F.col("file_name")).alias("extension"))


# Pages and chunks.


@query("page_merge", "SELECT source_id, page, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY coalesce(ord, 0), row_id), '')) AS text FROM page_text GROUP BY source_id, page")
def page_merge(spark: SparkSession, d: str) -> DataFrame:
    return pages.merge_pages(_read(spark, d, "page_text")).select("source_id", "page", F.md5("text").alias("text"))


_QUALITY = "q AS (SELECT row_id, arg_max(status, graded_at) FILTER (WHERE status IS NOT NULL) AS status FROM text_quality GROUP BY row_id)"


def _planned(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("case when text is null or trim(text) = '' then 'empty' when method is null then 'junk' when method = 'ocr' then 'degraded' else 'ok' end")
    rows = _read(spark, d, "extracted_pages").where("page is not null").select("source_id", "page", status.alias("status"), F.coalesce("images", F.lit(0)).alias("figures"))
    one = rows.groupBy("source_id", "page").agg(F.min("status").alias("status"), F.max("figures").alias("figures"))
    return one.withColumn("visual", F.col("figures") > 0)


_PLANNED = """e AS (SELECT source_id, page, min(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN method IS NULL THEN 'junk' WHEN method = 'ocr' THEN 'degraded' ELSE 'ok' END) AS status, max(coalesce(images, 0)) AS figures FROM extracted_pages WHERE page IS NOT NULL GROUP BY source_id, page),
    t AS (SELECT *, CASE WHEN status = 'junk' OR (status = 'empty' AND figures > 0) THEN 0 WHEN status = 'degraded' THEN 1 WHEN status = 'ok' AND figures > 0 THEN 2 END AS tier FROM e),
    n AS (SELECT *, CASE WHEN tier IS NOT NULL THEN row_number() OVER (PARTITION BY source_id, tier IS NULL ORDER BY tier, page) END AS place, count(tier) OVER (PARTITION BY source_id) AS planned FROM t)"""


@query("vision_plan", f"WITH {_PLANNED} SELECT source_id, page, status, CASE WHEN place <= 4 THEN CASE WHEN tier < 2 THEN 'ocr' ELSE 'describe' END END AS kind, planned > 4 AS truncated FROM n")
def vision_plan(spark: SparkSession, d: str) -> DataFrame:
    return pages.plan_vision(_planned(spark, d), 4)


@query("status_histogram", f"WITH {_PLANNED} SELECT status, count(*) AS pages, count(*) FILTER (WHERE place <= 4) AS planned FROM n GROUP BY status")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rollup.histogram(pages.plan_vision(_planned(spark, d), 4), "status", "pages", planned="kind")


@query("figure_detection", """WITH i AS (SELECT source_id, page, images AS key, images * 0.05 AS area, 20.0 - images AS contrast FROM extracted_pages WHERE page IS NOT NULL),
    l AS (SELECT * FROM i WHERE area >= 0.08), s AS (SELECT source_id, key, count(DISTINCT page) AS p FROM l GROUP BY source_id, key),
    f AS (SELECT source_id, page, count(*) AS figures FROM l JOIN s USING (source_id, key) WHERE p < 3 AND coalesce(contrast, 255) >= 18 GROUP BY source_id, page),
    b AS (SELECT source_id, page, max(length(text)) AS paths FROM extracted_pages WHERE page IS NOT NULL GROUP BY source_id, page)
    SELECT b.source_id, b.page, coalesce(figures, 0) AS figures, coalesce(figures, 0) > 0 OR coalesce(paths, 0) >= 50 AS visual FROM b LEFT JOIN f ON f.source_id IS NOT DISTINCT FROM b.source_id AND f.page = b.page""")
def figure_detection(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "extracted_pages").where("page is not null")
    images = e.select("source_id", "page", F.col("images").alias("image_key"), (F.col("images") * 0.05).alias("area"), (20.0 - F.col("images")).alias("contrast"))
    rows = pages.figures(images, e.groupBy("source_id", "page").agg(F.max(F.length("text")).alias("paths")))
    return rows.withColumn("figures", F.col("figures").cast("bigint"))


@query("document_method", f"SELECT source_id, CASE WHEN count(*) FILTER (WHERE f AND m <> 'text') = 0 THEN 'text' WHEN count(*) FILTER (WHERE f AND m <> 'ocr') = 0 THEN 'ocr' ELSE 'mixed' END AS method FROM (SELECT source_id, coalesce(method, 'text') AS m, regexp_replace(coalesce(text, ''), '{SPACE_SQL}', '', 'g') <> '' AS f FROM extracted_pages) GROUP BY source_id")
def document_method(spark: SparkSession, d: str) -> DataFrame:
    return pages.document_method(_read(spark, d, "extracted_pages"))


def _figures_sql(c: str) -> str:
    none = f"trim(trim(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '.،!:'), ' ' || chr(9) || chr(10) || chr(13)) IN ('', 'no figures')"
    kept = f"list_filter(str_split(cleaned, {_NL}), lambda l: starts_with(l, '[Figure]'))"
    return f"CASE WHEN {none} THEN '' WHEN len({kept}) > 0 THEN array_to_string({kept}, {_NL}) WHEN cleaned = '' THEN '' ELSE '[Figure] ' || cleaned END"


@query("assembled_pages", f"""WITH {_WITH_PRESENTED}, e AS (SELECT source_id, page, max(text) AS text FROM extracted_pages WHERE page IS NOT NULL AND source_id IS NOT NULL GROUP BY source_id, page),
    r AS (SELECT source_id, page, kind, text AS reply, row_number() OVER (PARTITION BY source_id, page ORDER BY created_at DESC, result_id DESC) AS n FROM vision_results WHERE page IS NOT NULL),
    j AS (SELECT e.*, kind, reply FROM e LEFT JOIN r ON r.source_id = e.source_id AND r.page = e.page AND n = 1),
    c AS (SELECT *, {_clean_sql("coalesce(reply, '')")} AS cleaned FROM j, presented),
    l AS (SELECT *, {_figures_sql("coalesce(reply, '')")} AS lines FROM c)
    SELECT source_id, page, CASE WHEN kind = 'ocr' AND reply IS NOT NULL THEN 'ocr' WHEN kind = 'describe' AND reply IS NOT NULL AND lines <> '' THEN 'text+vision' ELSE 'text' END AS method,
    md5(CASE WHEN kind = 'ocr' AND reply IS NOT NULL THEN cleaned WHEN kind = 'describe' AND reply IS NOT NULL AND lines <> '' THEN regexp_replace(regexp_replace(coalesce(text, '') || {_NL} || {_NL} || lines, '^{SPACE_SQL}+', ''), '{SPACE_SQL}+$', '') ELSE coalesce(text, '') END) AS text FROM l""")
def assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "extracted_pages").where("page is not null and source_id is not null").groupBy("source_id", "page").agg(F.max("text").alias("text"))
    replies = _read(spark, d, "vision_results").where("page is not null").groupBy("source_id", "page").agg(F.max_by(F.struct("kind", "text"), F.struct("created_at", "result_id")).alias("r"))
    out = pages.assemble(e.join(replies.select("source_id", "page", "r.kind", F.col("r.text").alias("reply")), ["source_id", "page"], "left"))
    return out.select("source_id", "page", "method", F.md5("text").alias("text"))


@query("figure_lines", f"WITH {_WITH_PRESENTED}, c AS (SELECT result_id, coalesce(text, '') AS reply, {_clean_sql("coalesce(text, '')")} AS cleaned FROM vision_results, presented), l AS (SELECT *, {_figures_sql('reply')} AS lines FROM c) SELECT result_id, md5(lines) AS lines, trim(trim(trim(reply, ' ' || chr(9) || chr(10) || chr(13)), '.،!:'), ' ' || chr(9) || chr(10) || chr(13)) IN ('', 'no figures') AS none FROM l")
def figure_lines(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "vision_results").select("result_id", F.md5(T.figure_lines(F.col("text"))).alias("lines"), T.no_figures(F.col("text")).alias("none"))


_VISION = "SELECT source_id, page, max(images) AS figures FROM extracted_pages WHERE page IS NOT NULL GROUP BY source_id, page"


@query("pagewise_extraction", f"""WITH m AS (SELECT source_id, page, max(text) AS text FROM extracted_pages WHERE source_id IS NOT NULL AND page IS NOT NULL GROUP BY source_id, page), k AS (SELECT *, source_id || '#' || page AS k FROM m),
    {_grade_sql('k', 'k')}, v AS ({_VISION}), s AS (SELECT k.source_id, k.page, g.status, coalesce(v.figures, 0) AS figures, g.readable FROM k JOIN graded g USING (k) LEFT JOIN v ON v.source_id = k.source_id AND v.page = k.page),
    t AS (SELECT *, CASE WHEN status = 'junk' OR (status = 'empty' AND figures > 0) THEN 0 WHEN status = 'degraded' THEN 1 WHEN status = 'ok' AND figures > 0 THEN 2 END AS tier FROM s),
    o AS (SELECT *, CASE WHEN tier IS NOT NULL THEN row_number() OVER (PARTITION BY source_id, tier IS NULL ORDER BY tier, page) END AS place, count(tier) OVER (PARTITION BY source_id) AS planned FROM t),
    r AS (SELECT source_id, page, arg_max(text, (created_at, result_id)) AS reply FROM vision_results WHERE page IS NOT NULL AND text IS NOT NULL GROUP BY source_id, page),
    j AS (SELECT o.*, reply, place <= 5 AS called FROM o LEFT JOIN r ON r.source_id = o.source_id AND r.page = o.page)
    SELECT source_id, count(*) AS pages, count(*) FILTER (WHERE called AND reply IS NOT NULL) AS vision_pages, count(*) FILTER (WHERE called AND reply IS NULL) AS failed_pages, bool_or(planned > 5) AS truncated FROM j GROUP BY source_id""")
def pagewise_extraction(spark: SparkSession, d: str) -> DataFrame:
    merged = _read(spark, d, "extracted_pages").where("source_id is not null and page is not null").groupBy("source_id", "page").agg(F.max("text").alias("text"))
    layout = _read(spark, d, "extracted_pages").where("page is not null").groupBy("source_id", "page").agg(F.max("images").alias("figures")).withColumn("visual", F.col("figures") > 0)
    replies = _read(spark, d, "vision_results").where("page is not null and text is not null").groupBy("source_id", "page").agg(F.max_by("text", F.struct("created_at", "result_id")).alias("reply"))
    return pages.extraction_report(pages.extract(merged, layout, replies, 5)).select("source_id", "pages", "vision_pages", "failed_pages", "truncated")


@query("default_chunks")
def default_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.default_chunks(_read(spark, d, "documents"), "doc_id", "text")


@query("default_chunks_of_words", """WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '[\\n.]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, str_split(t, ' ') AS ws FROM t WHERE length(t) > 300),
    s AS (SELECT doc_id, ws, 1 AS i, 0 AS chunk, ws[1] AS cur FROM w
        UNION ALL SELECT doc_id, ws, i + 1, chunk + more::INT, CASE WHEN more OR cur = '' THEN ws[i + 1] ELSE cur || ' ' || ws[i + 1] END FROM (SELECT *, cur <> '' AND length(cur) + 1 + length(ws[i + 1]) > 300 AS more FROM s WHERE i < len(ws))),
    c AS (SELECT doc_id, chunk, arg_max(cur, i) AS content FROM s GROUP BY doc_id, chunk UNION ALL SELECT doc_id, 0, t FROM t WHERE length(t) <= 300),
    n AS (SELECT doc_id, chunk, content, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM c WHERE content <> '' OR chunk = 0)
    SELECT doc_id, chunk AS chunk_index, md5(coalesce(right(before, 100), '') || content) AS content FROM n""")
def default_chunks_of_words(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[\\n.]+", " ").alias("text"))
    return chunking.default_chunks(rows, "doc_id", "text", 300, 100).select("doc_id", "chunk_index", F.md5("content").alias("content"))


@query("pages_chunks")
def pages_chunks(spark: SparkSession, d: str) -> DataFrame:
    cleaned = _read(spark, d, "page_text").withColumn("text", T.clean_text(F.col("text")))
    return chunking.pages_chunks(pages.merge_pages(cleaned))


@query("sections", f"""WITH RECURSIVE p AS (SELECT doc_id, str_split(text, {_NL} || {_NL}) AS ps FROM documents WHERE length(text) > 700),
    s AS (SELECT doc_id, ps, 1 AS i, 0 AS section, ps[1] AS content, length(ps[1]) + 2 AS n FROM p
        UNION ALL SELECT doc_id, ps, i + 1, section + more::INT, CASE WHEN more THEN right(content, 60) ELSE content END || {_NL} || {_NL} || ps[i + 1], CASE WHEN more THEN least(60, length(content)) ELSE n END + length(ps[i + 1]) + 2
        FROM (SELECT *, n + length(ps[i + 1]) + 2 > 700 AS more FROM s WHERE i < len(ps)))
    SELECT doc_id, section, md5(arg_max(content, i)) AS content FROM s GROUP BY doc_id, section UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 700""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(_read(spark, d, "documents"), "doc_id", "text", 700, 60).withColumn("content", F.md5("content"))


@query("reply_chunks", f"WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(str_split(coalesce(text, ''), '== '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS content FROM documents) SELECT doc_id, count(*) AS pieces, sum(length(content))::BIGINT AS chars FROM p GROUP BY doc_id")
def reply_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.explode(chunking.reply_chunks(F.coalesce("text", F.lit("")), "== ")).alias("content"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("content")).alias("chars"))


# Changes of a collection. What was written first is the stored side; ids that were written again arrive in their last form.


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _read(spark, d, "chunks").select("id", "notebook_id", "source_id", "content", "chunk_index", "seq").where("id is not null")
    both = c.groupBy("id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    c = c.join(both, "id")
    return c.where("seq = first").drop("first", "last"), c.where("seq = last and last > first").drop("first", "last")


_SIDES = """WITH b AS (SELECT id, min(seq) AS f, max(seq) AS l FROM chunks WHERE id IS NOT NULL GROUP BY id), st AS (SELECT c.* FROM chunks c JOIN b ON c.id = b.id AND c.seq = b.f), ar AS (SELECT c.* FROM chunks c JOIN b ON c.id = b.id AND c.seq = b.l AND b.l > b.f)"""


@query("upsert_sources", f"{_SIDES} SELECT id, source_id, seq FROM st WHERE source_id NOT IN (SELECT source_id FROM ar WHERE source_id IS NOT NULL) OR source_id IS NULL UNION ALL SELECT id, source_id, seq FROM ar")
def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    return ingest.upserted(*_sides(spark, d)).select("id", "source_id", "seq")


@query("stale_chunks", f"{_SIDES} SELECT id, source_id FROM st WHERE source_id IN (SELECT source_id FROM ar) AND id NOT IN (SELECT id FROM ar)")
def stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.stale(*_sides(spark, d)).select("id", "source_id")


@query("reembed_missing", f"{_SIDES} SELECT id FROM st WHERE coalesce(content, '') <> '' AND id NOT IN (SELECT id FROM chunk_vectors WHERE id IS NOT NULL)")
def reembed_missing(spark: SparkSession, d: str) -> DataFrame:
    return ingest.to_embed(_sides(spark, d)[0], _read(spark, d, "chunk_vectors")).select("id")


@query("delete_ids", f"WITH {CURRENT} SELECT count(*) AS deleted FROM cur WHERE id IN (SELECT query_id FROM similar_log)")
def delete_ids(spark: SparkSession, d: str) -> DataFrame:
    return ingest.delete_ids(_current(spark, d), _read(spark, d, "similar_log").select(F.col("query_id").alias("id")))[1]


@query("delete_notebook", "SELECT seq FROM chunks WHERE notebook_id <> 'nb_shared_library' OR notebook_id IS NULL")
def delete_notebook(spark: SparkSession, d: str) -> DataFrame:
    return ingest.delete_where(_read(spark, d, "chunks"), filters.matching(notebook="nb_shared_library")).select("seq")


@query("owner_conflicts", """SELECT p.source_id, to_json(list_sort(list(DISTINCT c.notebook_id))) AS owners FROM chunks c
    JOIN (SELECT DISTINCT source_id, notebook_id AS target FROM page_text) p ON p.source_id = c.source_id WHERE coalesce(c.notebook_id, '') <> '' AND c.notebook_id IS DISTINCT FROM p.target GROUP BY p.source_id""")
def owner_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.foreign_owners(_read(spark, d, "chunks"), _read(spark, d, "page_text"))
    return rows.select("source_id", F.to_json("owners").alias("owners"))


@query("move_report", f"WITH {CURRENT} SELECT n.notebook_id, count(c.id) AS chunks FROM (VALUES ('nb_shared_library'), ('nb_absent')) n(notebook_id) LEFT JOIN cur c USING (notebook_id) GROUP BY n.notebook_id")
def move_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.moved(*_halves(spark, d), ["nb_shared_library", "nb_absent", "nb_shared_library "])[2]


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _current(spark, d).withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0)))
    return rows, rows.where("notebook_id is null or chunk_index = 1").withColumn("source", F.lit("kept"))


@query("move_target", f"WITH {CURRENT} SELECT id, coalesce(source, '') AS source, 0.6::DOUBLE AS first FROM cur WHERE notebook_id = 'nb_shared_library' UNION ALL SELECT id, 'kept', 3.0::DOUBLE FROM cur WHERE (notebook_id IS NULL OR chunk_index = 1) AND coalesce(notebook_id, '') <> 'nb_shared_library'")
def move_target(spark: SparkSession, d: str) -> DataFrame:
    after = ingest.moved(*_halves(spark, d), ["nb_shared_library"])[1]
    return after.select("id", F.coalesce("source", F.lit("")).alias("source"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("move_source", f"WITH {CURRENT} SELECT id FROM cur WHERE notebook_id IS DISTINCT FROM 'nb_shared_library'")
def move_source(spark: SparkSession, d: str) -> DataFrame:
    return ingest.moved(*_halves(spark, d), ["nb_shared_library"])[0].select("id")


@query("chunk_ids", "SELECT seq, printf('%s:%05d', source_id, chunk_index) AS id FROM chunks WHERE chunk_index IS NOT NULL")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "chunks").where("chunk_index is not null").select("seq", T.chunk_id(F.col("source_id"), F.col("chunk_index")).alias("id"))


@query("clean_ids", "SELECT doc_id, to_json(list_filter(list_distinct(list_transform([lower(lang), ' ' || lower(lang), source, ''], lambda x: trim(x))), lambda x: x <> '' AND x IS NOT NULL).list_sort()) AS ids FROM documents")
def clean_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(F.lower("lang"), F.concat(F.lit(" "), F.lower("lang")), F.col("source"), F.lit(""))
    return _read(spark, d, "documents").select("doc_id", F.to_json(F.array_sort(T.clean_ids(ids))).alias("ids"))
