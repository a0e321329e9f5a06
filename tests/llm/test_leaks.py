import random
import re
import unicodedata

from pyspark.sql import functions as F

from hemiciclo.llm.leaks import leaked, longest_leaks


def words(t):
    plain = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_matches_brute_force(spark):
    r = random.Random(8)
    vocabulary = "agua Plan café ñandú 2027 la de una meta x".split()
    make = lambda k: "".join(w + r.choice([" ", ", ", "\n", " — ", "  "]) for w in r.choices(vocabulary, k=k))
    items = [(i, make(r.randrange(3, 40))) for i in range(30)] + [(90, None), (91, ""), (None, "agua " * 30), (92, "solo siete palabras que no bastan aquí")]
    docs = []
    for d in range(300):
        text = make(r.randrange(30))
        if d % 3 == 0:
            w = items[r.randrange(30)][1].split()
            a = r.randrange(len(w))
            text += " " + " ".join(w[a : a + r.randrange(4, 20)]).upper() + " " + make(5)
        docs.append((d, text))
    docs += [(400, None), (401, ""), (402, "!!!"), (403, docs[0][1]), (404, make(20_000)), (404, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("q"))
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(docs, [x for x in items if x[0] is not None], 8)
    for kw in ({}, {"shard_bytes": 2000}, {"block_chars": 500}):
        assert {tuple(x) for x in leaked(df, tests, "doc_id", "text", "item_id", "text", words=8, **kw).collect()} == want
    assert len(want) > 20
    assert leaked(df.limit(0), tests, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked(df, tests.limit(0), "doc_id", "text", "item_id", "text").columns == ["doc_id", "item_id"]


def test_longest_match_and_its_places(spark):
    item = " ".join(f"w{i}" for i in range(60))
    w = item.split()
    docs = [(1, "a b c " + " ".join(w[5:30]) + " x " + " ".join(w[30:52]).upper()), (2, " ".join(w[:20]) + " y " + " ".join(w[1:21])), (3, " ".join(w[:19])), (3, item), (3, "z " + item)]
    found = longest_leaks(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame([(7, item), (8, "k " + item)], "i long, t string"), "d", "t", "i", "t")
    assert {tuple(r) for r in found.collect()} == {(1, 7, 25, 4, 6), (1, 8, 25, 4, 7), (2, 7, 20, 1, 1), (2, 8, 20, 1, 2), (3, 7, 60, 1, 1), (3, 8, 60, 1, 2)}
