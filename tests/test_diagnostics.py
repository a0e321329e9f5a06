import math
import random

from pyspark.sql import functions as F

from hemiciclo.functions import rules as R
from hemiciclo.operators import copies, vectors


def greedy(rows):
    used, out = set(), set()
    for g, a, b, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            out.add((g, a, b, s))
    return out


def test_rounds_of_best_pairs_are_the_greedy_choice(spark):
    r = random.Random(4)
    rows = list({(g, a, b): (g, a, b, r.choice([1.0, 1.5, 2.0, r.random()])) for g in "xy" for a, b in ((f"a{r.randrange(25)}", f"b{r.randrange(25)}") for _ in range(160))}.values())
    rows += [("z", f"a{i}", f"b{j}", 1.0 - 0.01 * (i + j)) for i in range(6) for j in (i, i + 1)]  # a chain
    df = spark.createDataFrame([*rows, ("n", None, "b", 1.0), ("n", "a", "b", None), rows[0]], "g string, a string, b string, s double").withColumn("far", F.lit(1))
    assert {tuple(x) for x in copies.one_to_one(df, ["g"], "a", "b", "s").collect()} == greedy(rows)
    assert copies.one_to_one(df.limit(0), ["g"], "a", "b", "s").count() == 0


def test_near_links(spark):
    r = random.Random(6)
    words = [f"w{i:02}" for i in range(40)]
    base = [(sorted(r.sample(words, 12)), [r.gauss(0, 1) for _ in range(6)]) for _ in range(8)]
    rows = []
    for i in range(120):
        t, v = r.choice(base)
        t = sorted({w if r.random() > 0.12 else r.choice(words) for w in t})
        rows.append((f"k{i:03}", r.choice("pqr"), t, [x + r.gauss(0, 0.12) for x in v]))
    rows += [("few", "p", ["w01"], [1.0] * 6), ("none", None, rows[0][2], rows[0][3]), ("nov", "p", rows[0][2], None), ("short", "r", rows[0][2], [1.0])]
    classes = {}
    for k, p, t, v in rows:
        if p and v and len(t) >= 8:
            classes.setdefault((tuple(t), p), []).append((k, v))
    reps = [(min(m)[0], p, set(t), min(m)[1]) for (t, p), m in classes.items()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    want = set()
    for a in reps:
        for b in reps:
            if a[0] < b[0] and a[1] != b[1] and len(a[3]) == len(b[3]):
                c, j = cos(a[3], b[3]), len(a[2] & b[2]) / len(a[2] | b[2])
                if c >= 0.93 and (j >= 0.65 or (c >= 0.985 and j >= 0.45)):
                    want.add((a[0], b[0], a[1], b[1]))
    df = spark.createDataFrame(rows, "id string, party string, tokens array<string>, v array<double>").withColumn("k", F.lit(1)).withColumn("s", F.lit(2))
    got = copies.near_links(df, "id", "party", "tokens", "v").collect()
    assert {tuple(x)[:4] for x in got} == want and len(got) == len(want) > 20
    assert copies.near_links(df.limit(0), "id", "party", "tokens", "v").count() == 0
    apart = copies.near_links(df.drop("v"), "id", "party", "tokens", "v", vectors=df.select("id", "v")).collect()
    assert sorted(map(tuple, apart)) == sorted(map(tuple, got))


def test_near_links_move_few_bytes(spark, tmp_path):
    """Most sets meet no other: their vectors stay where they are, and sets travel as words."""
    r = random.Random(8)
    vocabulary = [f"palabra{i}larga" for i in range(3000)]
    sets = [(f"k{i:05}", "pq"[i % 2], r.sample(vocabulary, 20)) for i in range(4000)]
    sets += [(f"z{k[1:]}", "r", t) for k, _, t in sets[:30]]
    spark.createDataFrame(sets, "id string, party string, tokens array<string>").write.parquet(f"{tmp_path}/sets")
    spark.createDataFrame([(k, [float(r.gauss(0, 1)) for _ in range(48)] if k[0] == "k" and int(k[1:]) >= 30 else [1.0 + int(k[1:])] + [0.5] * 47) for k, *_ in sets], "id string, v array<double>").write.parquet(f"{tmp_path}/vectors")

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        each = spark._jsc.sc().statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = written()
    links = copies.near_links(spark.read.parquet(f"{tmp_path}/sets"), "id", "party", "tokens", "v", vectors=spark.read.parquet(f"{tmp_path}/vectors"))
    assert {(x["key_a"], x["key_b"]) for x in links.collect()} == {(k, f"z{k[1:]}") for k, *_ in sets[:30]}
    moved = written() - before
    assert moved < 2_800_000, moved
    keys = spark.createDataFrame([("k00007",), ("k00009",), (None,)], "id string")
    some = {x["id"] for x in copies.among(spark.read.parquet(f"{tmp_path}/vectors"), "id", keys).collect()}
    assert {"k00007", "k00009"} <= some and len(some) < 10


def test_exact_links_and_the_choice_between_kinds(spark):
    t = "x" * 90
    rows = [("b", "q", t), ("a", "p", t), ("c", "p", t), ("d", "r", t), ("e", "p", "y" * 90), ("f", None, t), ("g", "q", "corto"), ("h", "p", "corto"), ("i", "p", None)]
    exact = copies.exact_links(spark.createDataFrame(rows, "id string, party string, form string"), "id", "party", "form")
    assert {tuple(x) for x in exact.collect()} == {("a", "b", "p", "q"), ("a", "d", "p", "r")}
    near = spark.createDataFrame([("a", "b", "p", "q", 0.99, 0.9), ("u", "v", "p", "q", 0.95, 0.7), ("u", "v", "p", "q", 0.97, 0.66)], "key_a string, key_b string, party_a string, party_b string, cosine double, jaccard double")
    got = {(x["key_a"], x["key_b"]): (x["kind"], x["cosine"]) for x in copies.merged_links(exact, near).collect()}
    assert got == {("a", "b"): ("exact_duplicate", 1.0), ("a", "d"): ("exact_duplicate", 1.0), ("u", "v"): ("near_duplicate", 0.97)}


def test_pairs_of_groups_in_blocks(spark):
    c = spark.createDataFrame([(f"g{i:02}", [float(i), 1.0]) for i in range(23)], "g string, centroid array<double>")
    half = [(x["group_i"], x["group_j"]) for x in vectors.pairs_of_groups(c, "g", blocks=5).collect()]
    assert len(half) == len(set(half)) == 23 * 22 // 2 and all(a < b for a, b in half)
    assert vectors.pairs_of_groups(c, "g", square=True, blocks=3).count() == 23 * 23
    edges = vectors.group_similarity(c.withColumn("axis", F.when(F.col("g") < "g10", "x").otherwise("y")), "g", "axis", 0.0, digits=None)
    best = vectors.strongest(edges, "axis", 4).collect()
    for axis in "xy":
        want = sorted(((-e["similarity"], e["group_i"], e["group_j"]) for e in edges.where(F.col("axis") == axis).collect()))[:4]
        assert [(-e["similarity"], e["group_i"], e["group_j"]) for e in sorted((b for b in best if b["axis"] == axis), key=lambda e: e["place"])] == want


def test_phrases_seeds_signals_and_defaults(spark):
    df = spark.createDataFrame([("Hospital, agua",), ("uno,  dos, dos , tres, cuatro",), ("",), (None,)], "t string")
    assert [x[0] for x in df.select(R.topic_phrase(F.col("t"))).collect()] == ["Salud y atención de calidad", "Uno · Dos · Tres", "Agenda programática prioritaria", "Agenda programática prioritaria"]
    df = spark.createDataFrame([("Se incrementará el gasto", True), ("Se incrementará el gasto", False), ("Los gobiernos deberán crear postas", False), ("nada", True), (None, True)], "t string, p boolean")
    assert [x[0] for x in df.select(R.seeded(F.col("t"), F.col("p"))).collect()] == [True, False, True, False, None]
    df = spark.createDataFrame([(80.0, 0.5, None), (None, None, None)], "s double, a double, i double")
    assert [round(x[0], 6) for x in df.select(R.signal(F.col("s"), F.col("a"), F.col("i"))).collect()] == [0.55, 0.0]
    df = spark.createDataFrame([(None, "", "x" * 300), ("d", "s", None), ("", None, None)], "doc string, snip string, text string").withColumn("other", F.lit(1))
    assert [tuple(x)[:2] for x in R.with_defaults(df, "doc", "snip", "text").collect()] == [("doc_missing", "x" * 250), ("d", "s"), ("doc_missing", None)]


def test_published_patterns(spark):
    from hemiciclo.functions import lexicons as lex

    df = spark.createDataFrame([("el monto 1202645 crece",), ("en 100 días",), ("hasta el 2026-2031",), ("15% en 3,5 y 2.000",)], "t string")
    got = df.select(R.horizon(F.col("t")).alias("h"), R.numbers(F.col("t")).alias("n")).collect()
    assert [(x["h"], x["n"]) for x in got] == [(False, "1202645"), (True, "100"), (True, "2026;2031"), (False, "15;3,5;2.000")]
    assert isinstance(lex.PLAN_WORDS, list)


def test_hot_token_is_split(spark):
    r = random.Random(9)
    sets = {f"s{i:03}": {"hot", *(f"w{r.randrange(9)}" for _ in range(4))} for i in range(90)}
    rows = [(k, sorted(v)) for k, v in sets.items()] + [("none", []), ("null", None)]
    df = spark.createDataFrame(rows, "k string, t array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    for hot in (7, 5000):
        got = [(x["k_a"], x["k_b"]) for x in copies.similar_sets(df, "k", "t", 0.6, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    classes = {x["k"]: (x["class_key"], x["members_n"]) for x in copies.set_classes(df, "k", "t").collect()}
    assert classes == {k: (min(o for o in sets if sets[o] == v), sum(w == v for w in sets.values())) for k, v in sets.items()}


def test_texts_of_statements_without_a_pair_are_not_kept(spark, tmp_path):
    """Neither forms nor words of statements that meet no other are written to the cluster's folder."""
    from pathlib import Path

    from hemiciclo.plans import diagnostics
    from hemiciclo.session import checkpointed

    r = random.Random(11)
    vocabulary = [f"palabra{''.join(r.choices('bcdfglmnprst', k=9))}" for _ in range(3000)]
    texts = [(f"k{i:05}", "pq"[i % 2], " ".join(r.sample(vocabulary, 40))) for i in range(4000)]
    texts += [(f"z{k[1:]}", "r", f"{t} {'nuevo' if i % 2 else ''}") for i, (k, _, t) in enumerate(texts[:30])]
    spark.createDataFrame(texts, "proposal_id string, party string, proposal_text string").write.parquet(f"{tmp_path}/propuestas.parquet")
    spark.createDataFrame([(k, [1.0 + int(k[1:]), 0.5]) for k, *_ in texts], "proposal_id string, embedding array<double>").write.parquet(f"{tmp_path}/proposal_vectors.parquet")
    checkpointed(spark.range(1))
    kept = lambda: sum(p.stat().st_size for p in Path(spark._jsc.sc().getCheckpointDir().get().removeprefix("file:")).rglob("*") if p.is_file())
    before = kept()
    got = {(x["key_a"], x["key_b"]): x["kind"] for x in diagnostics.duplicate_pairs(spark, str(tmp_path)).collect()}
    assert got == {(k, f"z{k[1:]}"): "near_duplicate" if i % 2 else "exact_duplicate" for i, (k, *_) in enumerate(texts[:30])}
    assert kept() - before < 1_000_000, kept() - before


def test_keys_of_texts_of_one_party_stay_where_they_are(spark, tmp_path):
    r = random.Random(12)
    rows = [(f"{r.getrandbits(256):064x}", "pq"[i % 2], f"{i:05} {'x' * 90}") for i in range(4000)]
    rows += [(f"z{k}", "r", t) for k, _, t in rows[:20]] + [(f"z{k}", p, t) for k, p, t in rows[20:40]]
    spark.createDataFrame(rows, "id string, party string, form string").write.parquet(f"{tmp_path}/forms")

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        each = spark._jsc.sc().statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = written()
    links = copies.exact_links(spark.read.parquet(f"{tmp_path}/forms"), "id", "party", "form").collect()
    assert {(x["key_a"], x["key_b"]) for x in links} == {(k, f"z{k}") for k, *_ in rows[:20]} and len(links) == 20
    moved = written() - before
    assert moved < 300_000, moved
