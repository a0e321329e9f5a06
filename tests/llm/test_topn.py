import random

from pyspark.sql import functions as F

from hemiciclo.llm.topn import top_n

KEYS = ["a", "b"]


def brute(rows, n):
    best = {}
    for a, b, item, score in rows:
        if None in (a, b, item, score) or score != score:
            continue
        k = (a, b, item)
        best[k] = max(best.get(k, score), score)
    groups = {}
    for (a, b, item), score in best.items():
        groups.setdefault((a, b), []).append((-score, item.encode()))
    return {(*g, item.decode()) for g, items in groups.items() for _, item in sorted(items)[:n]}


def found(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "a string, b string, item string, score double").withColumn("group", F.lit(1)).withColumn("n", F.lit("x"))
    return {(r.a, r.b, r.item) for r in top_n(df.repartition(5), KEYS, "item", "score", n, **kw).collect()}


def test_matches_brute_force_with_ties_repeats_nulls_and_a_hot_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "x", "x", "y", "ñ", None]), r.choice(["p", "q", None]), r.choice([None, *(f"i{k}é" for k in range(300))]), r.choice([None, float("nan"), 0.0, -0.0, -1.5, *[round(r.random(), 1) for _ in range(4)]])) for _ in range(4000)]
    rows += [("hot", "g", f"h{k}", round(r.random(), 2)) for k in range(6000)] + [("one", "g", "z", 1.0)] * 7
    for n in (1, 3, 10):
        assert found(spark, rows, n, buffer_rows=500) == brute(rows, n)


def test_empty_and_none_wanted(spark):
    assert found(spark, [], 3) == set()
    assert found(spark, [("a", "b", "i", 1.0)], 0) == set()
    assert found(spark, [(None, "b", "i", 1.0), ("a", "b", "i", float("nan"))], 3) == set()
