import random

import pytest
from pyspark.sql import functions as F

from hemiciclo.functions import rules as R
from hemiciclo.operators import copies, groups, models, overlap, search, segment, vectors


def test_sections_and_statements(spark):
    df = spark.createDataFrame([(1, "EJE UNO\na\nb\nEJE DOS\nc"), (2, "x\n\n y "), (3, None), (4, ""), (5, "SOLO TITULO")], "id int, text string").withColumn("heads", F.lit(0))
    got = sorted(tuple(r) for r in segment.sections(df, "id", "text").collect())
    assert got == [(1, 2, "EJE UNO", "a\nb"), (1, 3, "EJE DOS", "c"), (2, 1, "INTRODUCCION", "x\ny")]
    text = "EJE UNO\n- Construir una posta de salud en la quebrada alta.\n- corto\nVamos a crear una escuela grande en el barrio sur. Nada más."
    rows = segment.statements(spark.createDataFrame([(7, text), (8, None)], "id int, text string"), "id", "text").orderBy("statement_id").collect()
    assert [r["statement_id"] for r in rows][:1] == ["doc_7_p0001"] and rows[0]["statement"].startswith("Construir una posta")
    assert len({r["statement"] for r in rows}) == len(rows)


def test_clean_pages(spark):
    pages = [("d", 1, "Plan X\nuna agri-\ncultura\n1"), ("d", 2, "Plan X\nsigue el tex-\n2"), ("d", 3, "Plan X\nto final\n3"), ("e", 1, "solo"), ("e", 2, None)]
    got = {r["doc"]: r["text"] for r in segment.clean_pages(spark.createDataFrame(pages, "doc string, page_no int, text string")).collect()}
    assert got == {"d": "una agricultura\n\nsigue el texto final", "e": "solo"}


def test_components(spark):
    r = random.Random(1)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(220))] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(120)] + [("z", "z"), (None, "z")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in copies.connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert copies.connected(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_greedy_matching(spark):
    rows = [("g", "a1", "b1", 2.9), ("g", "a1", "b2", 2.8), ("g", "a2", "b1", 2.7), ("g", "a2", "b2", 2.6)]
    got = {(x["a"], x["b"]) for x in copies.one_to_one(spark.createDataFrame(rows, "g string, a string, b string, s double"), ["g"], "a", "b", "s").collect()}
    assert got == {("a1", "b1"), ("a2", "b2")}


@pytest.mark.parametrize("least", [0.5, 0.65, 0.8, 1.0])
def test_similar_sets(spark, least):
    r = random.Random(2)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(1, 14))] for _ in range(40)]
    sets = {f"s{i:03}": {w if r.random() > 0.1 else "new" for w in r.choice(base)} for i in range(160)}
    rows = [(k, sorted(v)) for k, v in sets.items()] + [("none", []), ("null", None)]
    got = {(x["k_a"], x["k_b"]): x["jaccard"] for x in copies.similar_sets(spark.createDataFrame(rows, "k string, t array<string>"), "k", "t", least).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert got == pytest.approx(want)


def test_only_pairs_within_the_bounds_are_written():
    """Few different words, so that most sets share rare tokens: millions of pairs meet, and few are written."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 300, r.integers(14, 60))) for _ in range(3000)]
    sets = [*base, *(np.append(t[1:], 301 + i) for i, t in enumerate(base[:40]))]
    hashed = r.integers(-(1 << 63), 1 << 63, 400)
    counts = np.bincount(overlap.bucket(hashed[np.concatenate(sets)]), minlength=overlap.BUCKETS)
    ids = np.arange(len(sets))
    for least, hot in ((0.45, 20_000), (0.8, 500)):
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([hashed[t] for t in sets])], names=["id", "t"])
        rows = pa.Table.from_batches(list(overlap.probes([batch], counts, least, hot))).sort_by([("g", "ascending"), ("size", "ascending")])
        got = pa.Table.from_batches(list(overlap.met(rows.combine_chunks().to_batches(10_000), least)), schema=pa.schema([("x", pa.int64()), ("y", pa.int64())]))
        found = set(zip(got["x"].to_pylist(), got["y"].to_pylist()))
        m = np.zeros((len(sets), 400), dtype=np.float32)
        for i, t in enumerate(sets):
            m[i, t] = 1
        common, n = m @ m.T, m.sum(1)
        a, b = np.nonzero(np.triu(common / (n[:, None] + n - common) >= least - 1e-9, 1))
        want = set(zip(a.tolist(), b.tolist()))
        assert want <= found and len(want) >= 40
        assert len(got) < 20_000, len(got)


def test_a_set_without_a_key_has_no_pair(spark):
    rows = [("a", ["x", "y", "z"]), (None, ["x", "y", "z"]), ("b", ["x", "y", "z", "z"])]
    got = copies.similar_sets(spark.createDataFrame(rows, "k string, t array<string>"), "k", "t").collect()
    assert [tuple(x) for x in got] == [("a", "b", 1.0)]


def test_exact_classes(spark):
    t = "x" * 90
    rows = [(1, "p", t), (2, "q", t), (3, "p", t), (4, "p", "y" * 90), (5, "p", "y" * 90), (6, "q", "corto"), (7, "p", "corto"), (8, "p", None)]
    got = sorted(tuple(x) for x in copies.exact_classes(spark.createDataFrame(rows, "id int, party string, form string"), "id", "party", "form").collect())
    assert got == [(1, "p", 1, 2), (2, "q", 1, 2), (3, "p", 1, 2)]


def test_scores_have_a_total(spark):
    df = R.annotated(spark.createDataFrame([("p", "salud"), ("p", "agua"), ("q", None), (None, "salud")], "g string, t string"), "t").withColumn("axis", F.col("topic.axis"))
    got = {(x["g"], x["axis"]): (x["statements_n"], x["axis_share"]) for x in groups.group_scores(df, "g", "axis").collect()}
    assert got[("p", "overall")] == (2, 1.0) and got[("p", "salud")] == (1, 0.5) and got[("q", "otros")] == (1, 1.0) and got[("(none)", "overall")] == (1, 1.0)


def test_contradictions(spark):
    rows = [("p", "tax_policy", "raise_tax", "k1", 0.5), ("p", "tax_policy", "raise_tax", "k0", 0.5), ("p", "tax_policy", "cut_tax", "k2", 0.7), ("q", "tax_policy", "cut_tax", "k3", 0.9), (None, "tax_policy", "cut_tax", "k4", 0.9), ("r", "tax_policy", "cut_tax", "k5", None), ("r", "tax_policy", "raise_tax", "k5", 0.1)]
    got = [tuple(x) for x in groups.contradictions(spark.createDataFrame(rows, "party string, dimension string, stance string, k string, s double"), "party", "k", "s").collect()]
    assert got == [("p", "tax_policy", "raise_tax", "k0", "cut_tax", "k2", 60.0)]
    hits = groups.stance_hits(spark.createDataFrame([("a", "Aumentar impuestos"), ("b", "aumentar impuestos y reducir impuestos"), ("c", None)], "id string, t string"), "id", "t").collect()
    assert [(h["id"], h["stance"]) for h in hits] == [("a", "raise_tax")]


def test_blindspots_and_metrics(spark):
    covered = spark.createDataFrame([("p", "d", str(n), 100, n) for n in (0, 2, 5, 20)], "party string, dim string, coverage_group string, statements_n long, covered_n long")
    assert [x["blindspot_flag"] for x in groups.blindspots(covered).orderBy("coverage_share").collect()] == ["sin_cobertura", "muy_baja", "baja", "cobertura_ok"]
    m = groups.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a"), ("c", None)], "t string, p string"), "t", "p")
    got = {x["class"]: (x["support"], x["precision"], x["recall"]) for x in groups.class_metrics(m).collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, 0.5, 1.0)}


def test_vectors(spark):
    df = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0]), ("h", [2.0, 2.0]), ("z", [0.0, 0.0]), ("n", None)], "g string, v array<double>")
    c = vectors.centroids(df, ["g"], "v")
    assert {x["g"]: x["centroid"] for x in c.collect()} == {"g": [0.5, 0.5], "h": [2.0, 2.0], "z": [0.0, 0.0]}
    s = {(x["group_i"], x["group_j"]): x["similarity"] for x in vectors.group_similarity(c, "g").collect()}
    assert s[("g", "h")] == s[("h", "g")] == s[("g", "g")] == 1.0 and s[("g", "z")] == 0.0
    assert vectors.group_similarity(c, "g", least=0.9).count() == 1


def test_search(spark):
    df = spark.createDataFrame([(1, "agua en zona rural", 30.0, True, False), (2, "otra", 0.0, False, False), (3, "agua rural", None, None, None)], "id int, corpus string, s double, q boolean, h boolean")
    got = {x["id"]: x["search_score"] for x in search.scored(df, "corpus", "Agua, RURAL", "s", "q", "h").collect()}
    assert got == {1: 6.2, 2: 0.0, 3: None}
    assert [x["id"] for x in search.top(df, "id", "agua rural", "corpus", "s", "q", "h").collect()] == [1]
    assert search.scored(df, "corpus", "", "s", "q", "h").where("id = 1").first()["search_score"] == 2.0


def test_tfidf(spark):
    got = {(x["d"], x["term"]): (x["n"], x["tf_idf"]) for x in groups.tfidf(spark.createDataFrame([(1, "agua agua posta"), (2, "agua"), (3, None), (4, "")], "d int, t string"), "d", "t", ["posta"]).collect()}
    assert got == {(1, "agua"): (2, 0.0), (2, "agua"): (1, 0.0)}


def test_models(spark):
    r = random.Random(3)
    words = {"a": "agua cuenca riego presa canal".split(), "b": "escuela aula docente beca libro".split()}
    rows = [(f"k{i:03}", " ".join(r.choices(words["ab"[i % 2]], k=12)), "ab"[i % 2], float(i % 2), float(r.random())) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, t string, y string, f double, g double")
    pred = models.cross_validated(df, "k", "t", "y")
    assert pred.count() == 160 and pred.where("truth = pred").count() > 150
    vecs = models.svd_vectors(df, "k", "t", 4)
    assert vecs.count() == 160 and len(vecs.first()["embedding"]) == 4
    topics = models.topics(df, "k", "t", 2)
    assert topics.count() == 160 and {x["topic"] for x in topics.collect()} <= {1, 2}
    predicted, curves = models.readiness(df.withColumn("s", F.col("f") * 10 + F.col("g")), "k", "s", ["f", "g"], trees=10)
    assert models.errors(predicted)["r2"] > 0.8
    means = {(x["feature"], x["value"]): x["mean"] for x in curves.collect()}
    assert means[("f", 1.0)] - means[("f", 0.0)] > 5


def test_choices_and_numbers(spark):
    df = spark.createDataFrame([("metro y salud", "otro", None, 5.0, 20.0), ("nada", "social", "1;7", 5.0, 20.0), (None, None, "3", 5.0, 20.0), ("agua 12", "x", "3", 5.0, 20.0)], "t string, g string, n string, a double, z double")
    got = df.select(R.reclassified(F.col("t"), [("transporte", "metro|tren")], F.col("g"), ["social"], [("ambiente", "agua")]).alias("c"), R.first_plausible(F.col("n"), F.col("t"), F.col("a"), F.col("z")).alias("v"), R.recoded(F.col("g"), {"social": "S"}).alias("r")).collect()
    assert [tuple(x) for x in got] == [("transporte", None, "otro"), ("social", 7.0, "S"), ("otros", None, None), ("ambiente", 12.0, "x")]
    line = spark.createDataFrame([(2024, 10.0, 3.0)], "y int, b double, t double").select(*(R.milestone(F.col("y"), F.col("b"), F.col("t"), y) for y in (2027, 2029, 2031))).first()
    assert tuple(line) == (7.0, 5.0, 3.0)


def test_pages_of_search(spark):
    df = spark.createDataFrame([(i, "agua rural" if i % 2 else "agua", float(i), False, False, "p" if i < 30 else "q", "a") for i in range(60)], "id int, corpus string, s double, q boolean, h boolean, party string, axis string")
    second = search.page(df, "id", "agua rural", "corpus", "s", "q", "h", 2, 10, where={"party": "p"})
    assert [r["id"] for r in second.collect()] == [9, 7, 5, 3, 1, 28, 26, 24, 22, 20]
    got = [tuple(r) for r in search.answer(search.top(df, "id", "agua rural", "corpus", "s", "q", "h", 8), "party", "axis").collect()]
    assert got == [("party", "q", 8), ("axis", "a", 8)]


def test_model_helpers(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 2), float(i % 7), float(10 * (i % 2)), [1.0, 2.0, 3.0], "a") for i in range(100)], "k string, f double, g double, y double, v array<double>, l string")
    assert models.importances(df, "k", "y", ["f", "g"], 10)[0][0] == "f"
    assert tuple(models.plane(df, "k", "v").first())[1:] == (1.0, 2.0, "svd_first2")
    assert models.label_source(df, df.limit(1), "l", 60)[1] == "gold" and models.label_source(df.limit(3), df, "l", 60)[1] == "silver"


def test_statement_ids_differ_beyond_9999(spark):
    text = "\n".join(f"- Construir la posta número {i} en el distrito con fondos del municipio." for i in range(10_020))
    ids = [r[0] for r in segment.statements(spark.createDataFrame([(7, text)], "id int, text string"), "id", "text").select("statement_id").collect()]
    assert len(ids) == len(set(ids)) > 10_000 and "doc_7_p0001" in ids and "doc_7_p10001" in ids
