import pytest
from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import rules as R
from hemiciclo.functions import text as T


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [tuple(x)[1:] for x in df.select("i", *columns).orderBy("i").collect()]


def test_normalisers(spark):
    rows = ["  Á\xa0b\t c \r\n\r\n\r\n\r\n d ", None, "", "Ñandú N.º 5"]
    got = values(spark, rows, T.normalized(F.col("t")), T.folded(F.col("t")), T.slug(F.col("t")))
    assert got == [("Á b c\n\nd", "a b c d", "a-b-c-d"), (None, None, None), ("", "", ""), ("Ñandú N.º 5", "nandu n 5", "nandu-n-5")]


def test_headings(spark):
    rows = ["1.2 Salud", "EJE SOCIAL", "abc", "Plan de Salud", "una línea cualquiera, con coma", "X" * 141, None, "IV. Agua"]
    assert [x[0] for x in values(spark, rows, T.is_heading(F.col("t")))] == [True, True, False, True, False, False, None, True]


def test_page_numbers_and_hyphens(spark):
    assert [x[0] for x in values(spark, ["Página 3 de 10", "3/10", "- 3 -", "en la página 3", "12"], T.is_page_number(F.col("t")))] == [True, True, True, False, True]
    assert values(spark, ["agri-\ncultura fami-\nliar y\notra.\nFin"], T.dehyphenated(F.col("t"))) == [("agricultura familiar y otra.\nFin",)]


def test_names_of_files(spark):
    got = values(spark, ["/a/b/Grupo Azul - Ana.txt", "Solo.txt"], T.leading_part(F.col("t")), T.doc_id(F.col("t")))
    assert got[0][0] == "Grupo Azul" and got[1] == ("Solo", "doc_solo_txt")


@pytest.mark.parametrize(
    ("text", "axis", "share"),
    [("salud hospital seguridad", "salud", 2 / 3), ("policia y hospital", "seguridad", 0.5), ("xyz", "otros", 0.0), ("", "otros", 0.0), (None, "otros", 0.0)],
)
def test_topic(spark, text, axis, share):
    ((t,),) = values(spark, [text], R.topic(F.col("t")))
    assert t["axis"] == axis and t["confidence"] == pytest.approx(share)


def test_rules(spark):
    rows = ["al 15% en 2026 y 20.000", "programa de inversión", "Fortalecer todo", None]
    got = values(spark, rows, R.numbers(F.col("t")), R.first_class(F.col("t")), R.vague(F.col("t")))
    assert got == [("15;2026;20.000", "unspecified", False), (None, "program", False), (None, "unspecified", True), (None, "unspecified", None)]
    df = spark.createDataFrame([("hasta 2030 la meta es un programa de 5 millones",), ("Mejorar",), (None,)], "t string")
    scores = [r["score"] for r in R.annotated(df, "t").collect()]
    assert scores == [60, 0, 0]


def test_spanish_numbers_and_amounts(spark):
    assert [x[0] for x in values(spark, ["1.500,50", "20.000", "3,5", "1.000.000", "x"], R.spanish_number(F.col("t")))] == [1500.5, 20.0, 3.5, 1e6, None]
    got = values(spark, ["S/ 5000 millones y 3 mil millones", "5000 casas", "gasto de 0 soles"], R.amounts(F.col("t")))
    assert [x[0] for x in got] == [[5e9, 3e9], [], []]


def test_token_sets(spark):
    assert values(spark, ["La salud, la SALUD y el agua"], T.token_set(F.col("t"), lex.STOPWORDS)) == [(["salud", "agua"],)]


def test_snippet(spark):
    df = spark.createDataFrame([("antes. La posta de salud. después", "la posta de  salud"), ("otra cosa", "no está")], "d string, s string")
    got = [r[0] for r in df.select(T.snippet(F.col("d"), F.col("s"), 5)).collect()]
    assert got == ["tes. La posta de salud. des", "no está"]
