import json

import pytest

from hemiciclo.sources import baseline as B
from hemiciclo.streaming import flows


def test_plan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Grupo Azul - Ana Ñ.txt").write_text("línea\nuno", encoding="utf-8")
    (tmp_path / "x resumen.txt").write_text("no")
    (tmp_path / "y.pdf").write_text("no")
    got = [(r["party"], r["doc_id"], r["text"]) for r in B.plan_files(spark, str(tmp_path)).collect()]
    assert got == [("Grupo Azul", "doc_grupo_azul_ana_n", "línea\nuno")]


def test_replies(spark):
    monthly = {"config": {"series": [{"name": "IPC"}]}, "periods": [{"name": "Dic.2024", "values": ["2.0"]}, {"name": "Dic.25", "values": ["3.5"]}, {"name": "Ene.2026", "values": ["9"]}, {"name": "Feb.2026", "values": ["n.d."]}]}
    late = {"config": {"series": [{"name": "L"}]}, "periods": [{"name": "Ene.2027", "values": ["1"]}, {"name": "Feb.2027", "values": ["2"]}]}
    df = spark.createDataFrame([("A", json.dumps(monthly)), ("B", "<html>"), ("C", json.dumps(late)), ("D", None)], "code string, body string")
    got = {r["code"]: (r["series"], r["year"], r["value"]) for r in B.monthly_snapshot(df, "code", "body", 2025).collect()}
    assert got == {"A": ("IPC", 2025, 3.5), "B": (None, None, None), "C": ("L", 2027, 2.0), "D": (None, None, None)}
    yearly = [{}, [{"date": "2024", "value": None, "indicator": {"value": "x"}}, {"date": "2023", "value": 4.0, "indicator": {"value": "x"}}, {"date": "2022", "value": 3.0, "indicator": {"value": "x"}}]]
    df = spark.createDataFrame([("A", json.dumps(yearly)), ("B", "[]")], "code string, body string")
    got = {r["code"]: (r["indicator"], r["year"], r["value"]) for r in B.yearly_latest(df, "code", "body").collect()}
    assert got == {"A": ("x", 2023, 4.0), "B": (None, None, None)}


def test_upsert_and_contract(spark):
    base = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    new = spark.createDataFrame([("k2", 9, "n")], "k string, v int, extra string")
    assert sorted(tuple(r) for r in B.upserted(["k"], base, new).collect()) == [("k1", 1, None), ("k2", 9, "n")]
    assert B.with_contract(base, ["k", "v"], new) is base and B.with_contract(base, ["k", "x"], new) is new


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_sinks(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    B.write_rows(df, str(tmp_path / "o"), kind)
    B.write_rows(df.limit(0), str(tmp_path / "o"), kind, once=True)
    back = getattr(spark.read.option("header", True) if kind == "csv" else spark.read, kind)(str(tmp_path / "o"))
    assert back.count() == 2


def test_latin_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("código;nombre\nX1;Inflación\n".encode("latin-1"))
    assert [tuple(r) for r in B.series_metadata(spark, str(tmp_path / "m.csv")).collect()] == [("X1", "Inflación")]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "salud hospital"), (2, None), (3, "hasta 2030 un programa")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    flows.run_once(flows.annotated_stream(spark, str(tmp_path / "in"), df.schema, "doc_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["doc_id"]: (r["axis"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("salud", 0), 2: ("otros", 0), 3: ("otros", 50)}
    events = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:10:00', 'a', 1.0), (timestamp'2024-01-01 00:50:00', 'a', 2.0), (timestamp'2024-01-01 09:00:00', 'b', 1.0) AS t(ts, kind, value)")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    flows.run_once(flows.windowed_counts(stream, "ts", "kind", "value"), str(tmp_path / "w"), str(tmp_path / "cpw"))
    batch = flows.windowed_counts(events, "ts", "kind", "value")
    assert batch.count() == 2
    done = [(r["kind"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "w")).collect()]
    assert ("a", 2, 3.0) in done


def test_pages_and_errors(spark):
    def extractor(data):
        if data == b"bad":
            raise ValueError("broken file")
        return data.decode().split("\f") if data else []

    files = spark.createDataFrame([("a", bytearray(b"uno\fdos")), ("b", bytearray(b"bad")), ("c", bytearray(b"")), ("d", bytearray(b" "))], "path string, content binary")
    pages, errors = B.extracted_pages(files, extractor)
    assert sorted(tuple(r) for r in pages.collect()) == [("a", 1, "uno"), ("a", 2, "dos")]
    assert sorted(tuple(r) for r in errors.collect()) == [("b", "ValueError: broken file"), ("c", "no pages"), ("d", "no text")]


def test_baseline(spark):
    from pyspark.sql import functions as F

    spec = spark.createDataFrame([("A",), ("B",)], "code string")
    built = B.built_baseline(spec, spark.createDataFrame([("A", 1.23456789)], "code string, value double"), spark.createDataFrame([("A", "x"), ("A", "x")], "code string, unit string"), "code")
    assert sorted(tuple(r) for r in built.collect()) == [("A", 1.234568, "x"), ("B", None, None)]
    assert [r[0] for r in B.missing_values(built, "code", "value").collect()] == ["B"]
    fresh = spark.createDataFrame([("A", 2.0)], "code string, value double")
    once = B.replaced(built, fresh, ["code"], F.col("unit") == "x")
    twice = B.replaced(once, fresh, ["code"], F.col("unit") == "x")
    assert sorted(tuple(r) for r in once.collect()) == sorted(tuple(r) for r in twice.collect()) == [("A", 2.0, None), ("B", None, None)]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,x\n1,"uno, dos\ntres",1.5\n2,"dice ""sí""",\n', encoding="utf-8")
    got = B.delimited(spark, str(tmp_path / "a.csv"))
    assert dict(got.dtypes) == {"id": "int", "t": "string", "x": "double"}
    assert sorted(tuple(r) for r in got.collect()) == [(1, "uno, dos\ntres", 1.5), (2, 'dice "sí"', None)]
    assert B.delimited(spark, str(tmp_path / "a.csv"), "id long, t string, x string").schema["id"].dataType.simpleString() == "bigint"
