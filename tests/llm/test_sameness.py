import random
import unicodedata

from pyspark.sql import functions as F

from hemiciclo.llm.sameness import look_alike_classes, look_alikes, one_form, plain

SAME = ["La acción fina: S/ 5 socio-ambiental", "Lа acciόn ﬁna: S/ 5 socio‑ambiental", "La acción fina: S/ 5 socio‐ambiental", "Ｌａ ac​ción fina： Ｓ／ ５ socio-ambiental﻿", "La acción fina: S/ 5 so­cio-ambiental"]
DIFFERENT = ["La accion fina: S/ 5 socio-ambiental", "la acción fina: S/ 5 socio-ambiental", "La acción fina: S/ 5 socio-ambiental.", "La acción\nfina: S/ 5 socio-ambiental", "La acción  fina: S/ 5 socio-ambiental", "m² N.º", "m2 N.o", "5", "６", "", " "]


def test_pairs(spark):
    rows = [(f"s{i}", t) for i, t in enumerate(SAME)] + [(f"d{i}", t) for i, t in enumerate(DIFFERENT)] + [("n1", None), ("n2", None), ("x1", "igual"), ("x2", "igual"), (None, SAME[0])]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("form", F.lit(1)).withColumn("key", F.lit(2))
    got = {tuple(r) for r in look_alikes(df, "id", "text").collect()}
    assert got == {(f"s{i}", f"s{j}") for i in range(5) for j in range(i + 1, 5)}
    assert look_alikes(df.limit(0), "id", "text").count() == 0


def test_spliced_equals_whole():
    r = random.Random(7)
    chars = "aeioncs -\n" + "áéñ" + "ｌｏ５" + "ﬁﬂ" + "а" + "́̃̈" + "​­ " + "²º" + "한ᄒ" + "한" + "水🌾"
    for _ in range(3000):
        text = "".join(r.choices(chars, k=r.randrange(12))).replace("­", "")
        whole = unicodedata.normalize("NFC", "".join(map(plain, unicodedata.normalize("NFD", text))))
        assert one_form(text) == whole == one_form(whole), ascii(text)
    assert one_form(None) is None and one_form("") == "" and one_form("almace­\nnes") == "almace-\nnes"
    assert one_form("á" * 100_000) == "á" * 100_000


def test_classes_hold_every_link_without_pairs(spark):
    rows = [(f"h{i:04}", "agua pura" if i % 3 else "аgua pura" if i % 2 else "ａｇｕａ pura") for i in range(600)] + [("e1", ""), ("e2", ""), ("n", None), (None, "agua pura"), ("z", "otra cosa")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("key", F.lit("k")).withColumn("form", F.lit(1))
    got = {r["id"]: r for r in look_alike_classes(df, "id", "text").collect()}
    assert len(got) == 603 and got["h0001"]["class_key"] == "h0000" and got["h0001"]["spellings_n"] == 3 and got["h0001"]["links_n"] == 200
    assert got["e2"]["class_key"] == "e1" and got["e2"]["links_n"] == 0 and got["z"]["members_n"] == 1
    pairs = look_alikes(df, "id", "text")
    assert pairs.count() == pairs.distinct().count() == sum(r["links_n"] for r in got.values()) // 2
    assert look_alike_classes(df.limit(0), "id", "text").count() == 0
