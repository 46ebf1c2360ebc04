import glob
import os

import pytest

from corpuslake.llm import queries as Q
from corpuslake.llm import visual_form


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = Q.queries()[name](spark, data)
    cur = c.execute(Q.oracle_sql()[name])
    at = [[x[0] for x in cur.description].index(n) for n in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, data, name):
    rows = Q.queries()[name](spark, data).count()
    assert rows > 0 or name == "p8_paraphrases"  # the smallest tables need hold none


def test_forms_of_both_tables(spark, data):
    forms = Q.p2_forms(spark, data)
    assert forms.columns == ["table_name", "key", "form"]
    n = {r["table_name"]: r["count"] for r in forms.groupBy("table_name").count().collect()}
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    assert n == {"page_text": spark.read.parquet(f"{data}/page_text.parquet").count(), "chunks": chunks.where("id is not null").select("id").distinct().count() + chunks.where("id is null").count()}
    # Records that p2_found pairs have one form.
    by = {(r["table_name"], r["key"]): r["form"] for r in forms.collect()}
    pairs = Q.p2_found(spark, data).collect()
    assert pairs and all(by[r["table_name"], r["key_a"]] == by[r["table_name"], r["key_b"]] for r in pairs)


def test_forms_take_the_valid_version(spark):
    rows = [("a", 1, "old"), ("a", 2, "nеw"), ("b", 5, None), ("b", 4, "text"), ("c", None, "x"), ("c", 0, "ｙ"), (None, 1, "p"), (None, 1, "q")]
    df = spark.createDataFrame(rows, "id string, seq long, content string")
    out = visual_form.forms_of_tables([("chunks", df, "id", "content", "seq")]).collect()
    assert sorted((str(r["key"]), str(r["form"])) for r in out) == [("None", "p"), ("None", "q"), ("a", "new"), ("b", "None"), ("c", "y")]
