"""Every operator on tables with odd keys, null columns and extra columns whose names its plans use inside."""

import pytest
from pyspark.sql import functions as F

from corpuslake.llm import encodings, leakage, line_quality, long_spans, mixing, neighbours, scan_noise, tree_split, truncation, visual_form

CLASHING = "key form own k v doc edge pos word n head gram cell rep ids q distance place total copies bucket rank start end path left right state reason inner kind value fix restored length near h r base step nr begin title at numbered flows words prose".split()
BIG = (1 << 62) + 1
LONG = "Een lange zin met genoeg letters om mee te doen. " * 60


def operators(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    pages = t([(BIG, "s", 1, "Title One\nsome words here\n- 1 -"), (BIG + 1, "s", 2, "Title One\nother words there\n- 2 -"), (None, None, None, None), (3, None, None, "a mer-\nchant"), (4, "s", 3, LONG)], "extract_id long, source_id string, page int, text string")
    texts = t([(BIG, LONG), (BIG + 1, LONG.replace("e", "е")), (None, LONG), (5, None), (6, ""), (7, "la forÃªt"), (None, "la forÃªt"), (7, "la forÃªt"), (8, "une forêt")], "row_id long, text string")
    chunks = t([("a", 1, LONG, 1, 2), ("a", None, "x", None, None), ("b", None, LONG, None, 3), ("b", None, LONG, None, 3), (None, None, None, None, None)], "id string, seq long, content string, page_start int, page_end int")
    replies = t([(BIG, None, "A sentence that ends. And one that does no"), (None, "s", "A whole sentence stands here."), (2, "s", None)], "result_id long, source_id string, text string")
    vectors = t([("a", [1.0] * 64), ("b", [1.0] * 64), ("c", [-1.0] * 64), ("a", [1.0] * 64), (None, [1.0] * 64), ("d", None), ("e", [None] * 64), ("f", [float("nan")] * 64)], "id string, embedding array<float>")
    docs = t([(BIG, 1, "x", LONG), (BIG + 1, 2, None, LONG), (None, None, "x", LONG), (4, None, "x", None), (BIG + 1, 2, "x", LONG)], "doc_id long, page_id long, source string, text string")
    items = t([(1, "b", LONG[:200]), (None, None, None), (2, None, "")], "item_id long, benchmark string, text string")
    targets = t([("x", 1.0, 2), (None, None, None)], "source string, target_share double, max_repeats int")
    return {
        "defects": (pages, scan_noise.defects), "repair": (pages, scan_noise.repair), "forms": (texts, lambda d: visual_form.visual_forms(d, "row_id", "text")),
        "pairs": (texts, lambda d: visual_form.look_alike_pairs([("t", d, "row_id", "text", None)])), "split": (chunks, tree_split.split_oversized), "cut": (replies, truncation.truncated),
        "mutual": (vectors, neighbours.mutual_pairs), "lists": (vectors, lambda d: neighbours.neighbour_lists(d, one_in=1)), "quality": (texts, line_quality.line_quality),
        "garbled": (texts, lambda d: encodings.garbled_records([("t", d, "row_id", "text")], 1)), "leaks": (docs, lambda d: leakage.leaks(d, items)), "mix": (docs, lambda d: mixing.mix(d, targets)),
        "spans": (docs, long_spans.shared_spans), "part": (docs, lambda d: long_spans.shared_part(d, long_spans.shared_spans(d))),
    }


EXPECTED = {"split": {("a", 0)}, "pairs": {(str(BIG), str(BIG + 1))}, "mutual": {("a", "b")}, "spans": {(BIG, BIG + 1)}, "cut": {(BIG, True), (None, False)}}
NAMES = ["defects", "repair", "forms", "pairs", "split", "cut", "mutual", "lists", "quality", "garbled", "leaks", "mix", "spans", "part"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, name):
    df, f = operators(spark)[name]
    plain = sorted(map(str, f(df).collect()))
    extra = df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
    assert sorted(map(str, f(extra).collect())) == plain
    assert f(df.limit(0)).count() == 0
    out = f(df)
    if name == "pairs":
        # Row 1 has Cyrillic letters; a null key pairs with nothing.
        assert {(r["key_a"], r["key_b"]) for r in out.collect()} == EXPECTED["pairs"]
    if name == "split":
        assert {r["id"] for r in out.collect()} == {"a", "b"}
    if name == "mutual":
        assert {(r["id_a"], r["id_b"]) for r in out.collect()} == EXPECTED["mutual"]
    if name == "cut":
        assert {(r["result_id"], r["is_cut"]) for r in out.collect()} == EXPECTED["cut"]
    if name == "spans":
        assert {(r["doc_a"], r["doc_b"]) for r in out.collect()} == EXPECTED["spans"]
    if name == "garbled":
        assert sorted(str(r["record_id"]) for r in out.collect()) == ["7", "7", "None"]
    if name in ("forms", "quality"):
        assert {r["key"] for r in out.collect()} >= {BIG, BIG + 1, None}
    if name == "mix":
        assert {r["doc_id"] for r in out.collect()} == {BIG, BIG + 1, None, 4}
