import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import browse, rollup
from corpuslake.plans import ingest
from corpuslake.plans.catalog import Catalog, ConflictError, Flags, FencedError, MissingError, space_of
from corpuslake.plans.providers import CalledEmbedder, HashedEmbedder, ProviderError, VocabularyEmbedder, retried
from corpuslake.plans.requests import IngestText
from corpuslake.sources import files


def pages(spark, n, notebook="nb", source="s"):
    rows = [(i, source, notebook, "f.pdf", i, 0, f"Sentence number {i} about volcano. " * 60) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "row_id int, source_id string, notebook_id string, source string, page int, ord int, text string")


def test_collection_life(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.create("live_docs", Flags.new(64))
    with pytest.raises(ConflictError):
        c.create("live_docs")
    with pytest.raises(MissingError):
        c.entry("absent")
    e = HashedEmbedder(64)
    ingest.store_pages(c, "live_docs", pages(spark, 6), e)
    before = {r["id"] for r in c.read("live_docs").collect()}
    ingest.store_pages(c, "live_docs", pages(spark, 6), e)
    assert {r["id"] for r in c.read("live_docs").collect()} == before
    ingest.store_pages(c, "live_docs", pages(spark, 2), e)
    after = {r["id"] for r in c.read("live_docs").collect()}
    assert after < before
    with pytest.raises(ConflictError):
        ingest.store_pages(c, "live_docs", pages(spark, 1, "other"), e)
    c.create("live_docs__next", Flags.new(64))
    assert ingest.copy_missing(c, "live_docs", "live_docs__next", e)["embedded"] == len(after)
    assert ingest.copy_missing(c, "live_docs", "live_docs__next", e)["embedded"] == 0
    old = c.promote("live_docs__next", "live_docs")
    assert c.names() == sorted(["live_docs", old]) and c.read("live_docs").count() == len(after)
    with pytest.raises(ConflictError):
        c.drop("live_docs", live=("live_docs",))
    assert c.drop(old) > 0
    assert c.vacuum()["freed"] > 0
    with c.maintenance("live_docs"), pytest.raises(FencedError):
        c.write("live_docs", c.read("live_docs"))
    with pytest.raises(ConflictError):
        c.write("live_docs", c.read("live_docs"), expected=99)
    assert c.inventory().count() == 1 and c.disk_usage()[0][1] > 0
    assert c.reset("live_docs", "live_docs") == len(after) and c.read("live_docs").count() == 0


def test_of_two_writers_one_succeeds(spark, tmp_path):
    first, second = (Catalog(spark, str(tmp_path / "store")) for _ in range(2))
    first.create("docs", Flags.new(8))
    begun = second.entry("docs")
    rows = spark.createDataFrame([("a:00000", "n")], "id string, notebook_id string")
    rows = rows.select("id", "notebook_id", *(F.lit(None).alias(c) for c in "source_id source chunk_index page_start page_end content embedding seq".split()))
    first.write("docs", rows)
    # The second has read the entry before and comes to its commit after.
    second.entry = lambda name: begun
    with pytest.raises(ConflictError):
        second.write("docs", rows.limit(0))
    del second.entry
    assert second.read("docs").count() == 1 and second.entry("docs")["version"] == 1
    assert len([x for x in (tmp_path / "store").iterdir() if ".v" in x.name and not x.name.endswith(".crc")]) == 1
    with pytest.raises(ConflictError):
        second.create("docs")


def test_order_of_writing_over_sources(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.create("docs", Flags.new(8))
    e = HashedEmbedder(8)
    for source in ("z", "a", "m"):
        ingest.store_pages(c, "docs", pages(spark, 6, source=source), e)
    both = pages(spark, 4, source="q").unionByName(pages(spark, 4, source="p"))
    ingest.store_pages(c, "docs", both, e)
    rows = c.read("docs")
    assert rows.select("seq").distinct().count() == rows.count()
    listed = []
    for offset in range(0, rows.count(), 3):
        listed += [r["id"] for r in browse.page(rows, F.lit(True), 3, offset).orderBy("seq").collect()]
    by = {s: sorted(x for x in listed if x.startswith(s)) for s in "zampq"}
    assert listed == by["z"] + by["a"] + by["m"] + by["p"] + by["q"]
    assert [r["source_key"] for r in rollup.by_source(rows).orderBy("first_seq").collect()] == ["z", "a", "m", "p", "q"]


def test_flags_name_the_chunker_and_the_task(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    told = str(tmp_path / "told")

    def call(texts, task=None):
        open(told, "a").write(f"{task};")
        return [[1.0, 0.0] for _ in texts]

    for name, flags in (("plain", Flags(2)), ("tasked", Flags(2, True, True, "pages_v1", True, "cosine"))):
        c.create(name, flags)
        open(told, "w").close()
        ingest.store_request(c, name, IngestText("nb", "src", [(1, "word " * 300), (2, "more " * 300)]), CalledEmbedder(call))
        assert set(open(told).read().split(";")) == ({"None", ""} if name == "plain" else {"RETRIEVAL_DOCUMENT", ""})
    assert {r["page_start"] for r in c.read("plain").collect()} == {None}
    assert {r["page_start"] for r in c.read("tasked").collect()} == {1, 2}


def test_flags_are_strict():
    f = Flags.read({"dimensions": "7", "normalized": 1, "task_types": True, "chunker": "pages_v1", "hnsw": {"space": "ip"}})
    assert (f.dimensions, f.normalized, f.task_types, f.pages, f.space) == (3072, False, True, True, "ip")
    assert space_of({}) == "l2"


def test_move_reports_absent_notebooks(spark):
    rows = spark.createDataFrame([("1", "a", "x", [3.0, 4.0]), ("2", "b", "x", [0.0, 0.0])], "id string, notebook_id string, content string, embedding array<float>")
    left, right, report = ingest.moved(rows, rows.limit(0), ["a", "zz", " a"])
    assert [r["id"] for r in left.collect()] == ["2"]
    assert [round(x, 3) for x in right.first()["embedding"]] == [0.6, 0.8]
    assert {(r[0], r[1]) for r in report.collect()} == {("a", 1), ("zz", 0)}


def test_deletions_keep_rows_with_null_keys(spark):
    rows = spark.createDataFrame([("1", None), ("2", "a")], "id string, notebook_id string")
    assert [r["id"] for r in ingest.delete_where(rows, F.col("notebook_id") == "a").collect()] == ["1"]
    kept, n = ingest.delete_ids(rows, spark.createDataFrame([("2",), ("9",), (None,)], "id string"))
    assert kept.count() == 1 and n.first()[0] == 1


def test_embedders(spark):
    df = spark.createDataFrame([("a river river",), (None,), ("",)], "content string")
    assert [len(r["embedding"]) for r in HashedEmbedder(8).embed(df).collect()] == [8, 8, 8]
    assert VocabularyEmbedder(["river"]).embed(df, normalized=False).first()["embedding"] == pytest.approx([6.01])
    assert [r["embedding"] for r in CalledEmbedder(lambda ts: [[float(len(t))] for t in ts]).embed(df, normalized=False).collect()] == [[13.0], [0.0], [0.0]]
    with pytest.raises(ProviderError):
        retried(lambda: 1 / 0, 2, 0.0)


def packed(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return b.getvalue()


W, A, PP = (f'xmlns:{p}="http://x/{p}"' for p in ("w", "a", "p"))
DOCX = packed(**{"word__document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
SLIDE = f"<p:sld {A} {PP}><p:sp><p:txBody><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"
PPTX = packed(**{"ppt__slides__slide1.xml": SLIDE % " ", "ppt__slides__slide2.xml": SLIDE % "Hi", "ppt__slides__slide10.xml": SLIDE % "End"})


def test_formats(spark):
    rows = [
        ("a.TXT", b"caf\xc3\xa9 \xff"), ("b.json", b'\xef\xbb\xbf{"x": [1, "s", {"y": " "}, "t"]}'), ("c.json", b"{no"),
        ("d.json", '{"k": [{"major": "M", "university": "U", "requirements": ["r1", "", "r2"]}]}'.encode()),
        ("d2.json", '{"z": [{"university": 3, "major": " N ", "requirements": "plain"}], "a": [{"major": "A", "university": null, "requirements": [1, null]}], "q": 5}'.encode()), ("d3.json", b'[{"major": "M", "university": "U", "requirements": []}]'),
        ("k.json", '"only \\"one\\" \\u00e9:"'.encode()), ("l.json", b'{"a:": "x:", "b" : ["", {"c": "y\\n"}], "d": "z"}'), ("m.json", b""), ("n.json", None), ("o.json", b'["' + b"x" * 100_000 + b'"]'),
        ("e.html", b"<title>T</title><script>x</script><p>a <b>b</b>&amp; c<!-- z --></p>"), ("f.docx", DOCX), ("g.pptx", PPTX), ("h.zip", b"PK"), ("i.docx", b"broken"), (None, b"x"), ("j.txt", None),
    ]
    out = {r["file_name"]: (r["text"], r["error"]) for r in files.extract_text(spark.createDataFrame(rows, "file_name string, content binary")).collect()}
    assert out["a.TXT"][0] == "café �" and out["b.json"][0] == "s\nt" and out["c.json"][0] == "{no"
    assert out["d.json"][0].endswith("- r1\n- r2") and "U" in out["d.json"][0]
    form = "אוניברסיטה: {}\nתחום: {}\nתנאי קבלה:\n{}"
    assert out["d2.json"][0] == form.format("3", "N", "plain") + "\n\n" + form.format("", "A", "- 1") and out["d3.json"][0] == form.format("U", "M", "")
    assert out["k.json"][0] == 'only "one" é:' and out["l.json"][0] == "x:\ny\n\nz" and out["m.json"] == ("", None) and out["n.json"] == ("", None) and len(out["o.json"][0]) == 100_000
    assert out["e.html"][0] == "T\na\nb\n& c"
    assert out["f.docx"][0] == "One\ttwo\n\na | b" and out["g.pptx"][0] == "[Slide 2]\nHi\n\n[Slide 3]\nEnd"
    assert out["h.zip"] == ("", None) and out["i.docx"][0] is None and out["i.docx"][1]
    assert out[None] == ("", None) and out["j.txt"] == ("", None)


def test_bytes(spark):
    df = spark.createDataFrame([("/9j/AAAA",), ("not base64!!",), (None,)], "s string")
    assert [r[0] for r in df.select(files.image_kind(files.inline_bytes(F.col("s")))).collect()] == ["image/jpeg", None, None]
