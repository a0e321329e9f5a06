import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.operators import models

WORDS = {"a": "agua cuenca riego presa canal".split(), "b": "escuela aula docente beca libro".split(), "c": "salud posta médico vacuna cama".split()}


def labelled(n=150):
    r = random.Random(3)
    return [(f"k{i:03}", " ".join(r.choices(WORDS["abc"[i % 3]], k=10)) + " " + r.choice(["norte", "sur"]), "abc"[i % 3] if i % 10 else None, float(i % 2), float(r.random())) for i in range(n)]


def test_embedding_is_the_truncated_svd(spark):
    rows = [(k, t) for k, t, *_ in labelled(60)] + [("null", None), ("empty", ""), ("stop", "de la que")]
    bags = {k: Counter(w for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()) if w not in lex.STOPWORDS) for k, t in rows}
    bags = {k: b for k, b in bags.items() if b}
    terms = sorted({w for b in bags.values() for w in b})
    keys = sorted(bags)
    used = Counter(w for b in bags.values() for w in b)
    a = np.array([[bags[k][w] / sum(bags[k].values()) * math.log(len(keys) / used[w]) for w in terms] for k in keys])
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    df = spark.createDataFrame(rows, "k string, t string").withColumn("row", F.lit(0)).withColumn("w", F.lit("x"))
    for k in (3, 50):
        m = min(k, len(terms) - 1, len(keys) - 1)
        want = u[:, :m] * s[:m]
        got = {r["k"]: r["embedding"] for r in models.svd_vectors(df, "k", "t", k).collect()}
        assert sorted(got) == keys
        made = np.array([got[x] for x in keys])
        assert made.shape == want.shape
        assert np.abs(made @ made.T - want @ want.T).max() < 1e-6  # signs and turns among equal values aren't unique
    shared = models.svd_vectors(df, "k", "t", 3, columns=8).collect()
    assert len(shared) == len(keys) and len(shared[0]["embedding"]) == 3
    assert models.svd_vectors(df.limit(0), "k", "t").collect() == []


def test_topics_by_means(spark):
    df = spark.createDataFrame([(k, t) for k, t, *_ in labelled(90)], "k string, t string")
    got = models.topics_by_means(df, "k", "t", k=3).collect()
    groups = {}
    for r in got:
        groups.setdefault(int(r["k"][1:]) % 3, Counter())[r["topic"]] += 1
    assert len(got) == 90 and len({c.most_common(1)[0][0] for c in groups.values()}) == 3
    assert all(len(r["topic_label"].split(", ")) == 4 for r in got)
    assert [models.topics_number(n) for n in (1, 64, 100, 10_000)] == [6, 8, 10, 12]


def test_label_model_predicts_all_rows_and_is_kept(spark, tmp_path):
    rows = labelled(180) + [("rare", "agua agua", "z", 0.0, 0.0), ("none", "", None, 0.0, 0.0)]
    df = spark.createDataFrame([r[:3] for r in rows], "k string, t string, y string").withColumn("fold", F.lit(9)).withColumn("words", F.lit(""))
    model = models.LabelModel(df, "k", "t", "y", folds=3, penalties=(0.001, 0.5))
    assert model.penalty == 0.001  # the strong one knows nothing
    out = model.out_of_fold().collect()
    assert len(out) == sum(r[2] is not None for r in rows) - 1 and sum(r["truth"] == r["pred"] for r in out) > 0.95 * len(out)
    every = {r["k"]: r for r in model.predicted().collect()}
    assert len(every) == len(rows) and every["k000"]["truth"] is None and every["k000"]["pred"] == "a" and every["none"]["prob"] <= 1
    model.save(str(tmp_path / "m"))
    again = {r["k"]: r["pred"] for r in models.predicted_by(str(tmp_path / "m"), df, "k", "t").collect()}
    assert all(again[k] == r["pred"] for k, r in every.items())


def test_readiness_with_categories_and_spread(spark):
    r = random.Random(2)
    rows = [(f"k{i}", 10.0 * (i % 2) + 5.0 * (i % 3 == 0), float(i % 2), r.random(), 1.0, "x" if i % 3 == 0 else None, "same", "pq"[i % 2]) for i in range(300)] + [("n", None, 1.0, 1.0, 1.0, "x", "same", "p")]
    df = spark.createDataFrame(rows, "k string, y double, f double, g double, one double, c string, s string, party string")
    model = models.Readiness(df, "k", "y", ["f", "g", "one"], ["c", "s"], trees=10, others=["party"])
    assert model.features == ["f", "g"] and model.categories == ["c"]
    found = model.predictions("party")
    assert found.count() == 300 and models.errors(found)["r2"] > 0.8 and found.where("sd < 0 OR sd IS NULL").count() == 0
    gains = dict(model.importances())
    assert abs(sum(gains.values()) - 100) < 1e-6 and gains["f"] > gains["c"] > gains["g"]
    curves = model.dependence().collect()
    assert all(x["low"] <= x["mean"] <= x["high"] for x in curves) and {x["value"] for x in curves if x["feature"] == "f"} == {0.0, 1.0}
    sides = {x["party"]: x for x in models.residuals_by_group(found, "party").collect()}
    assert sum(x["rows_n"] for x in sides.values()) == 300 and {x["sign"] for x in sides.values()} <= {"underestimated", "overestimated"}
