import pytest
from pyspark.sql import functions as F

from corpuslake.operators import search
from corpuslake.plans import ingest, requests as R
from corpuslake.plans.catalog import Catalog, Flags
from corpuslake.plans.providers import VocabularyEmbedder
from corpuslake.plans.retrieve import Snapshots, conversation, retrieve, traced
from corpuslake.streaming import ingest as streaming

WORDS = ["photosynthesis", "chlorophyll", "fractions", "volcano"]
PAGE = "row_id int, source_id string, notebook_id string, source string, page int, ord int, text string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("store")))
    c.create("docs", Flags.new(4))
    rows = [(i, f"s{i}", "own" if i < 2 else "library", "f", 1, 0, f"{w} lesson number {i}. " * 8) for i, w in enumerate(WORDS)]
    ingest.store_pages(c, "docs", spark.createDataFrame(rows, PAGE), VocabularyEmbedder(WORDS))
    return c


def test_one_question(store):
    rows = retrieve(store, "docs", R.Retrieve("what is a volcano", notebooks=["library"], k=1), VocabularyEmbedder(WORDS)).collect()
    assert [r["source_id"] for r in rows] == ["s3"]
    assert [r["source_id"] for r in retrieve(store, "docs", R.Retrieve("volcano", sources=["s0", "s3"]), VocabularyEmbedder(WORDS)).collect()] == ["s3", "s0"]


def test_history_reaches_the_rewriter(store):
    turns = [("user", f"turn {i}") for i in range(7)] + [("assistant", "about volcano")]
    seen = lambda q, h: F.when(h.contains("Assistant: about volcano") & ~h.contains("turn 1"), "volcano").otherwise(q)
    ask = lambda history: [r["source_id"] for r in retrieve(store, "docs", R.Retrieve("explain more", notebooks=["own", "library"], history=history, k=1), VocabularyEmbedder(WORDS), None, seen).collect()]
    assert ask(turns) == ["s3"] and store.spark.range(1).select(conversation([])).first()[0] == "(no prior conversation)"


def test_equal_contents_show_the_first(spark):
    rows = spark.createDataFrame([("q", 1, "a", "x", 3), ("q", 2, "b", "y", 2), ("q", 3, "c", "x", 1)], "g string, rank int, id string, content string, new_rank int").withColumn("delta", F.col("rank") - F.col("new_rank"))
    out = search.same_content_first(rows, "g", ["id"]).orderBy("new_rank").collect()
    assert [(r["new_rank"], r["id"], r["rank"], r["delta"]) for r in out] == [(1, "a", 1, 0), (2, "b", 2, 0), (3, "a", 1, -2)]


def test_several_questions(store):
    rows = retrieve(store, "docs", R.Retrieve("volcano", queries=["fractions", " volcano "], notebooks=["own", "library"], k=2), VocabularyEmbedder(WORDS)).collect()
    assert [r["source_id"] for r in rows] == ["s3", "s2"]


def test_trace_and_snapshots(store):
    ranked, by = traced(store, "docs", R.Trace("chlorophyll", rerank=True, final_k=2), VocabularyEmbedder(WORDS))
    assert ranked.first()["source_id"] == "s1" and by.count() == 2
    s = Snapshots(store)
    assert s.sources("docs").count() == 4 and s.sources("docs") is s.sources("docs")
    assert s.notebook("docs", "own").first()["sources"] == 2 and s.notebook("docs", "none").first()["chunks"] == 0


@pytest.mark.parametrize("bad", [{"question": "q"}, {"question": " ", "notebooks": ["a"]}, {"question": "q", "notebooks": ["a"], "k": 41}, {"question": "q", "notebooks": ["a"], "queries": ["x"] * 13}])
def test_requests_are_checked(bad):
    with pytest.raises(R.RequestError):
        R.Retrieve(**bad)


def test_requests_are_brought_to_one_form():
    r = R.Retrieve("q", queries=["a ", "a", "", "q"], notebook="n", notebooks=[" m ", "m"])
    assert r.queries == ["q", "a"] and r.notebooks == ["m"]
    assert R.Trace("q", notebook="n", notebooks=["m"]).notebooks == ["m", "n"]
    for pages in ([], [(0, "x")], [(1, " ")]):
        with pytest.raises(R.RequestError):
            R.IngestText("n", "s", pages)
    with pytest.raises(R.RequestError):
        R.ids_to_delete([" "])


def test_stream_of_pages(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.create("docs", Flags.new(4))
    for n in range(2):
        spark.createDataFrame([(n, f"s{n}", "nb", "f", 1, 0, "volcano " * 40)], PAGE).write.mode("append").parquet(str(tmp_path / "in"))
    pages = streaming.page_stream(spark, str(tmp_path / "in"), PAGE)
    for _ in range(2):  # the second run finds nothing new
        q = streaming.ingest(pages, c, "docs", VocabularyEmbedder(WORDS), str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["source_id"] for r in c.read("docs").collect()} == {"s0", "s1"}
