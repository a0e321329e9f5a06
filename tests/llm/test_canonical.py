from pyspark.sql import functions as F

from hemiciclo.llm.canonical import Names, canonical, edits

REFERENCE = [(1, "Convergencia Andina Regional", "CAR"), (2, "Acción Laborista Industrial", "ALI"), (3, "Frente Soberano por un País Magisterial", "FSOM"), (4, "Frente Soberano por un País Municipalista", "FSPM"), (5, "Bloque Ecologista y Juvenil", "BEJ"), (6, None, "X"), (None, "Nadie", "N")]
TYPED = {
    "  Convergencia   Andina Regional\t": 1, "CONVERGENCIA ANDINA REGIONAL": 1, "Andina Regional": 1, "Andina Regional, Convergencia": 1, "Co. Andina Regional": 1, "(CAR)": 1, "C.A.R.": 1, "car": 1, "CAR - Convergencia Andina Reginoal": 1, "#ConvergenciaAndinaRegional": 1,
    "convergencia_andina_regional": 1, "c0nv3rg3ncia andina regional": 1, "ConvergenciaAndinaRegional": 1, "Converegncia Adina Regional": 1, "Convergencia Andino Regional": 1, "P.P. Convergencia Andina Regional": 1, "Convergencia Andina Regional (comité Salata)": 1,
    "acción laborista industiral...": 2, "AcciÃ³n Laborista Industrial": 2, "el Acción Laborista Industrial": 2, "Acción Laborista Industrial – 2da vuelta": 2, "Acción Laborista Industrial [inscrito]": 2, "Frente Soberano Pais Magisterial": 3, "Fr. Soberano por un País Magis.": 3, "bl0qu3 ecologista y juv3nil": 5,
    "Acción Astral Lacustre": -1, "folio 13": -1, "???": -1, "otro": -1, "Frente Soberano por un País": -1, "🌾": -1,
}


def test_ways_of_typing(spark):
    rows = [(f"r{i}", t) for i, t in enumerate(TYPED)] + [("null", None), ("blank", " \t"), ("exact", "Acción Laborista Industrial"), ("r0", list(TYPED)[0])]
    df = spark.createDataFrame(rows, "id string, party string").withColumn("distance", F.lit(0)).withColumn("key", F.lit(0))
    ref = spark.createDataFrame(REFERENCE, "party_id long, party_name string, party_code string")
    got = [tuple(r) for r in canonical(df, "id", "party", ref, "party_id", "party_name", "party_code").collect()]
    want = [(f"r{i}", k) for i, k in enumerate(TYPED.values())] + [("r0", 1)]
    assert sorted(got) == sorted(want)
    for block in (20, 1000):
        blocks = [tuple(r) for r in canonical(df, "id", "party", ref, "party_id", "party_name", "party_code", block=block).collect()]
        assert sorted(blocks) == sorted(want), block
    none = canonical(df, "id", "party", ref.limit(0), "party_id", "party_name", "party_code").collect()
    assert {r["party_id"] for r in none} == {-1} and canonical(df.limit(0), "id", "party", ref, "party_id", "party_name").count() == 0


def test_trie_finds_what_a_scan_finds():
    words = ["andina", "andino", "laborista", "laboral", "industrial", "magisterial", "municipalista", "regional", "regio"]
    names = Names.of([(i, w, None) for i, w in enumerate(words)])
    for typed in [*words, "andnia", "lavoral", "regioanl", "industriales", "xyz", "munizipalista"]:
        got = names.near(typed, 2)
        for i, w in enumerate(words):
            if edits(typed, w) <= 2:
                assert got[i] <= edits(typed, w)
        assert all(edits(typed, words[i]) <= 2 * d for i, d in got.items())


def test_blocks_agree_on_shared_aliases_and_long_names(spark):
    long = "Movimiento " + " ".join(f"vecino{i}" for i in range(400))
    ref = spark.createDataFrame([(1, "Norte Unido", "NU"), (2, "Unido Norte", "UN"), (3, "Frente Sur Andino", "FSA"), (4, "Alianza Sur Andino", "FSB"), (5, long, "ML")], "party_id long, party_name string, party_code string")
    typed = ["norte  unido", "UNIDO NORTE", "Sur Andino", "Frente Sur Andin", "nu", long.upper(), long[:-1]]
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(typed)], "id string, party string")
    want = {"r0": 1, "r1": 2, "r2": -1, "r3": 3, "r4": 1, "r5": 5, "r6": 5}
    for block in (7, 1000):
        assert {r["id"]: r["party_id"] for r in canonical(df, "id", "party", ref, "party_id", "party_name", "party_code", block=block).collect()} == want, block
    few = ref.where("party_id < 3")
    for block in (1, 1000):
        assert {r["id"]: r["party_id"] for r in canonical(df, "id", "party", few, "party_id", "party_name", "party_code", block=block).collect() if r["id"] in ("r0", "r1")} == {"r0": 1, "r1": 2}, block
