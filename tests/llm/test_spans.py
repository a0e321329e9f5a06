import random

from pyspark.sql import functions as F

from hemiciclo.llm.spans import shared_spans


def brute(rows, n):
    owners = {}
    for _, o, t in rows:
        for i in range(len(t or "") - n + 1):
            owners.setdefault(t[i : i + n], set()).add(o)
    out = set()
    for k, _, t in rows:
        covered = sorted({c for i in range(len(t or "") - n + 1) if len(owners[t[i : i + n]]) > 1 for c in range(i, i + n)})
        start = None
        for c in covered:
            if start is None or c != last + 1:
                if start is not None:
                    out.add((k, start + 1, last + 1))
                start = c
            last = c
        if start is not None:
            out.add((k, start + 1, last + 1))
    return out


def found(spark, rows, n):
    df = spark.createDataFrame(rows, "id string, doc string, text string").withColumn("h", F.lit(0)).withColumn("tid", F.lit(1)).withColumn("key", F.lit(""))
    return {(r["id"], r["span_start"], r["span_end"]) for r in shared_spans(df, "id", "doc", "text", n).collect()}


def test_matches_brute_force(spark):
    r = random.Random(4)
    passages = ["".join(r.choices("abcdé 🌾", k=r.randrange(10, 60))) for _ in range(12)]
    rows = []
    for k in range(150):
        text = "".join(r.choice(["".join(r.choices("abcdé ", k=r.randrange(1, 30))), (p := r.choice(passages))[r.randrange(5) :], p]) for _ in range(r.randrange(4)))
        rows.append((f"s{k}", f"d{r.randrange(9)}", text))
    rows += [("same1", "dx", "q" * 70), ("same2", "dx", "q" * 70), ("same3", "dy", "q" * 33), ("copy1", "a", passages[0]), ("copy2", "b", passages[0]), ("e", "a", ""), ("n", "a", None)]
    for n in (8, 21, 32):
        got = found(spark, rows, n)
        assert got == brute([x for x in rows if x[2] is not None], n)
        assert got


def test_hot_passage_nulls_and_empty(spark):
    passage = "la meta es construir una posta de salud en la quebrada alta " * 3
    rows = [(f"h{k}", f"d{k}", f"{k} {passage}") for k in range(400)] + [("o", None, passage), ("p", "d1", "corto")]
    got = found(spark, rows, 160)
    assert len(got) == 400 and ("h399", 2, 4 + len(passage)) in got
    assert found(spark, [], 160) == set()


def test_several_passes_of_a_small_filter(spark):
    r = random.Random(11)
    passages = ["".join(r.choices("abcdé ñ", k=40)) for _ in range(8)]
    rows = [(f"s{k}", f"d{k % 7}", "".join(r.choice([r.choice(passages), "".join(r.choices("abcdefgh", k=25))]) for _ in range(5))) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, doc string, text string")
    want = brute(rows, 21)
    for bits in (256, 4096):
        got = {(x["id"], x["span_start"], x["span_end"]) for x in shared_spans(df, "id", "doc", "text", 21, filter_bits=bits).collect()}
        assert got == want


def test_filter_keeps_every_block():
    import numpy as np

    from hemiciclo.llm.spans import in_pass, word_and_mask

    h = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 20_000)
    word, mask = word_and_mask(h, 999)
    assert word.min() >= 0 and word.max() == 998 and (mask != 0).all()
    assert sum(in_pass(h, k, 7).sum() for k in range(7)) == len(h)
