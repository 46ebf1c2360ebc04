import random

import pytest

from corpuslake.operators import chunking as C
from corpuslake.operators import pages as P


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_recursive_split_bounds_and_content():
    text = "\n\n".join(words(n, "w") + ". " + words(30, "v") for n in (10, 400, 3)) + "x" * 2000
    pieces = [text[a:b] for a, b in C.default_spans(text)]
    assert all(len(p) <= 800 for p in pieces)
    squeeze = lambda s: "".join(s.split()).replace(".", "")
    assert squeeze("".join(pieces)) == squeeze(text)
    assert C.default_texts("") == [""]


def test_default_spans_cut_at_the_coarsest_separator():
    spans = lambda t, n: [t[a:b] for a, b in C.default_spans(t, n)]
    assert spans("aa\n\nbb\n\ncc", 6) == ["aa\n\nbb", "cc"]
    assert spans("\n\n\n\naa\n\n\n\nbb", 6) == ["aa\n\n", "bb"]
    assert spans("aa bb. cc dd\nee", 8) == ["aa bb", "cc dd", "ee"]
    assert spans("x" * 20, 8) == ["x" * 8, "x" * 8, "x" * 4]
    assert C.default_texts("abcd efgh ijkl", 5, 2) == ["abcd", "cdefgh", "ghijkl"]


def test_default_chunks_overlap(spark):
    docs = spark.createDataFrame([(1, "a" * 1000), (2, None), (3, "")], "source_id int, text string")
    rows = C.default_chunks(docs).orderBy("source_id", "chunk_index").collect()
    assert [(r["source_id"], len(r["content"])) for r in rows] == [(1, 800), (1, 600), (3, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_page_chunks_cover_the_pages(seed):
    rng = random.Random(seed)
    pages = [(i + 1, "\n".join(words(rng.randint(1, 60), f"p{i}x") + "." for _ in range(rng.randint(0, 30)))) for i in range(12)]
    out = C.chunk_pages(pages)
    assert [c[0] for c in out] == list(range(len(out)))
    assert all(len(c[1]) <= C.MOST and c[2] <= c[3] for c in out)
    assert all(a[3] <= b[2] for a, b in zip(out, out[1:], strict=False))
    for page, text in pages:
        held = " ".join(c[1] for c in out if c[2] <= page <= c[3]).split()
        assert set(text.split()) <= set(held)


def test_short_tail_joins_and_empty_pages_vanish():
    assert C.chunk_pages([(1, "   "), (2, "")]) == []
    out = C.chunk_pages([(1, words(230, "a")), (2, "tail")])
    assert len(out) == 1 and out[0][2:] == (1, 2)


def test_pages_of_a_source_are_walked_in_batches(spark):
    rows = [("s", "n", "f", p, words(5 + p % 60, f"p{p}x") + ".") for p in range(1, 300)] + [("t", None, None, 1, None), ("s", "n", "f", 6001, "far " * 100), ("s", "n", "f", 6002, "further " * 200)]
    df = spark.createDataFrame(rows, "source_id string, notebook_id string, source string, page int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = C.pages_chunks(df.repartition(5)).orderBy("chunk_index").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = C.chunk_pages([(r[3], r[4]) for r in rows if r[0] == "s" and r[3] < 5000])
    far = C.chunk_pages([(r[3], r[4]) for r in rows if r[0] == "s" and r[3] > 5000])
    assert [(r["chunk_index"], r["content"], r["page_start"], r["page_end"]) for r in out] == near + [(100_000 + i, *x) for i, *x in far]
    assert out[0]["id"] == "s:00000" and {r["notebook_id"] for r in out} == {"n"}


def test_chunker_dispatch(spark):
    df = spark.createDataFrame([("s", "n", "f", 2, "b " * 500), ("s", "n", "f", 1, "a " * 500), (None, None, None, 1, "x")], "source_id string, notebook_id string, source string, page int, text string")
    assert [r["page_start"] for r in C.chunked(df, "pages_v1").collect()] == [1, 2]
    plain = C.chunked(df, None).orderBy("chunk_index").collect()
    assert [r["id"] for r in plain] == [f"s:{i:05d}" for i in range(len(plain))] and plain[0]["content"].startswith("a a") and plain[0]["page_start"] is None
    smart = C.chunked(df, "smart", spark.createDataFrame([("s", 0, "one<<<CHUNK>>> \n<<<CHUNK>>> two ")], "source_id string, section int, reply string"))
    assert [(r["chunk_index"], r["content"]) for r in smart.orderBy("chunk_index").collect()] == [(0, "one"), (1, "two")]
    with pytest.raises(ValueError, match="no chunker"):
        C.chunked(df, "other")


def test_sections_carry_over():
    parts = C.section_texts("\n\n".join("x" * 90 for _ in range(20)), 300, 50)
    assert all(b.startswith(a[-50:]) for a, b in zip(parts, parts[1:], strict=False))


def test_merge_pages(spark):
    rows = [(1, "s", "n", "f", 1, 1, "b"), (2, "s", "n", "f", 1, 0, "a"), (3, "s", "n", "f", 2, None, None)]
    df = spark.createDataFrame(rows, "row_id int, source_id string, notebook_id string, source string, page int, ord int, text string")
    assert {(r["page"], r["text"]) for r in P.merge_pages(df).collect()} == {(1, "a\n\nb"), (2, "")}


def test_plan_vision_takes_the_worst_first(spark):
    rows = [("s", 1, "ok", 1, True), ("s", 2, "junk", 0, False), ("s", 3, "degraded", 0, False), ("s", 4, "empty", 0, False), ("s", 5, "empty", 1, True), ("t", 1, "ok", 0, True)]
    df = spark.createDataFrame(rows, "source_id string, page int, status string, figures int, visual boolean")
    out = {(r["source_id"], r["page"]): (r["kind"], r["truncated"]) for r in P.plan_vision(df, 3).collect()}
    assert out == {("s", 1): (None, True), ("s", 2): ("ocr", True), ("s", 3): ("ocr", True), ("s", 4): (None, True), ("s", 5): ("ocr", True), ("t", 1): (None, False)}


def test_figures_leave_out_decoration(spark):
    images = spark.createDataFrame([("s", p, "logo", 0.2, None) for p in (1, 2, 3)] + [("s", 1, "f", 0.1, 20.0), ("s", 2, "faint", 0.5, 5.0), ("s", 2, "small", 0.01, 90.0)], "source_id string, page int, image_key string, area double, contrast double")
    paths = spark.createDataFrame([("s", 1, 0), ("s", 2, 60), ("s", 3, None)], "source_id string, page int, paths int")
    assert {(r["page"], r["figures"], r["visual"]) for r in P.figures(images, paths).collect()} == {(1, 1, True), (2, 0, True), (3, 0, False)}


def test_assemble_and_method(spark):
    rows = [("s", 1, "kept", None, None), ("s", 2, "", "ocr", "read\x00 text"), ("s", 3, "t", "describe", "[Figure] a"), ("s", 4, "t", "describe", "no figures"), ("s", 5, "t", "ocr", None)]
    df = P.assemble(spark.createDataFrame(rows, "source_id string, page int, text string, kind string, reply string"))
    assert [(r["text"], r["method"]) for r in df.orderBy("page").collect()] == [("kept", "text"), ("read text", "ocr"), ("t\n\n[Figure] a", "text+vision"), ("t", "text"), ("t", "text")]
    assert P.document_method(df).first()["method"] == "mixed"


def test_page_wise_extraction(spark):
    good = "A clean page of text with quite enough letters."
    pages = spark.createDataFrame([("a", 1, good), ("a", 2, "+-*/=<> " * 20), ("a", 3, None), ("a", 4, good), ("b", 1, ""), ("c", 1, "\ufffd" * 50)], "source_id string, page int, text string")
    layout = spark.createDataFrame([("a", 3, 0, True), ("a", 4, 2, True), ("b", 1, 1, True)], "source_id string, page int, figures int, visual boolean")
    replies = spark.createDataFrame([("a", 2, "Read anew."), ("a", 4, "[Figure] a tower"), ("a", 1, "not asked for")], "source_id string, page int, reply string")
    out = P.extract(pages, layout, replies)
    rows = {(r["source_id"], r["page"]): (r["status"], r["kind"], r["text"], r["method"], r["failed"]) for r in out.collect()}
    assert rows == {
        ("a", 1): ("ok", None, good, "text", False), ("a", 2): ("junk", "ocr", "Read anew.", "ocr", False), ("a", 3): ("empty", "ocr", "", "text", True),
        ("a", 4): ("ok", "describe", good + "\n\n[Figure] a tower", "text+vision", False), ("b", 1): ("empty", "ocr", "", "text", True), ("c", 1): ("junk", "ocr", "", "text", True),
    }
    report = {r["source_id"]: r for r in P.extraction_report(out).collect()}
    assert (report["a"]["method"], report["a"]["vision_pages"], report["a"]["failed_pages"], report["a"]["all_failed"]) == ("mixed", 2, 1, False)
    assert report["b"]["all_failed"] and report["c"]["all_failed"]
    assert P.extract(pages, layout, replies, 1).where("truncated").count() == 4
