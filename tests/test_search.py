import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import search
from corpuslake.functions import vectors as V


def brute(e, q, k, space):
    if space == "cosine":
        d = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T
    elif space == "ip":
        d = 1 - q @ e.T
    else:
        d = ((q[:, None] - e[None]) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("space", ["cosine", "ip", "l2"])
def test_knn_against_brute_force(spark, space):
    rng = np.random.default_rng(1)
    e = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(e)] + [(900, None, "x"), (901, [1.0], "x")], "id int, embedding array<double>, note string").repartition(3)
    rows = search.knn(df, df.where("id < 5"), 7, space).orderBy("query_id", "rank").collect()
    near, dist = brute(e, e[:5], 7, space)
    assert [r["id"] for r in rows] == near.ravel().tolist()
    assert np.allclose([r["distance"] for r in rows], dist.ravel())
    hof = df.where("size(embedding) = 16").crossJoin(df.where("id = 0").select(F.col("embedding").alias("q"))).select("id", V.distance(F.col("embedding"), F.col("q"), space).alias("d")).orderBy("d", "id").limit(7)
    assert [r["id"] for r in hof.collect()] == near[0].tolist()


def test_knn_ties_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 4, 3)], "id int, embedding array<double>")
    assert [r["id"] for r in search.knn(df, df.where("id = 5"), 2, "cosine", drop_self=True).orderBy("rank").collect()] == [3, 3]
    assert search.knn(df.limit(0), df, 3).count() == 0
    assert search.knn(df, df.limit(0), 3).count() == 0


def test_normalize_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_round_robin_takes_each_once_with_its_least_distance(spark):
    rows = [("r", 0, 1, "a", "A", 0.5), ("r", 0, 2, "b", "B", 0.6), ("r", 1, 1, "b", "B", 0.1), ("r", 1, 2, "a", "A", 0.2), ("r", 1, 3, "", "C", 0.9), ("r", 0, 3, "", "C", 0.8)]
    out = search.merge_round_robin(spark.createDataFrame(rows, "g string, query_index int, rank int, id string, content string, distance double"), ["g"], 5).orderBy("position").collect()
    assert [(r["id"], r["content"], r["distance"]) for r in out] == [("a", "A", 0.2), ("b", "B", 0.1), ("", "C", 0.8)]


def test_rerank_drops_repeats_and_what_is_out_of_range(spark):
    c = spark.createDataFrame([("q", i, f"c{i}") for i in (1, 2, 3, 4)] + [("n", 1, "x")], "g string, rank int, id string")
    r = spark.createDataFrame([("q", '{"order":[3,3,9,1]}'), ("n", "broken")], "g string, reply string")
    out = search.rerank(c, r, "g").where("g = 'q'").orderBy("new_rank").collect()
    assert [(x["id"], x["delta"]) for x in out] == [("c3", 2), ("c1", -1), ("c2", -1), ("c4", 0)]


def test_merge_dedupe_keeps_repeats_of_the_primary(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2)], "content string, seq int")
    s = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "content string, seq int")
    assert [(r["content"], r["part"]) for r in search.merge_dedupe(p, s).orderBy("part", "seq").collect()] == [("a", 0), ("a", 0), ("b", 1)]


def test_attribution_orders_by_count_then_first_appearance(spark):
    rows = [("q", 1, "a", "s1", "x", 0.3), ("q", 2, "b", "", "y", None), ("q", 3, "c", "", "y", 0.1), ("q", 4, "d", None, None, 0.2)]
    out = search.attribution(spark.createDataFrame(rows, "g string, rank int, id string, source_id string, source string, distance double"), ["g"]).orderBy("position").collect()
    assert [(r["label"], r["chunks"], r["best_distance"], r["first_id"]) for r in out] == [("y", 2, 0.1, "b"), ("s1", 1, 0.3, "a"), ("(unknown)", 1, 0.2, "d")]


def test_last_turns(spark):
    rows = [("a", i, "user", f"t{i}") for i in range(9)] + [("b", 0, "system", "x")]
    out = {r["g"]: [t["content"] for t in r["turns"]] for r in search.last_turns(spark.createDataFrame(rows, "g string, n int, role string, content string"), "g", ["n"]).collect()}
    assert out == {"a": [f"t{i}" for i in range(3, 9)], "b": ["x"]}
