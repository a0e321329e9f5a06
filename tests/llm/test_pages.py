import random

from pyspark.sql import functions as F

from hemiciclo.llm import pages as P

NOUNS = "posta escuela cuenca brigada parcela tarifa represa comedor vivero mercado".split()
KINDS = ["agua potable", "salud mental", "barrio sur", "empleo juvenil", "riego moderno"]


def sentence(r):
    return f"Para los vecinos proponemos construir la {r.choice(NOUNS)} de {r.choice(KINDS)} y reparar el {r.choice(NOUNS)} municipal en la quebrada del distrito con enfoque socio-ambiental."


def wrapped(text, width=48):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def corpus():
    r = random.Random(3)
    rows = []
    for d in range(6):
        place = ["tarapoma", "quilahua", "moyobe_alto", "nerica", "sapaqui", "zulapi"][d]
        title = f"Plan de trabajo vecinal – {place.replace('_', ' ').title()}"
        for k in range(40):
            lines = wrapped(" ".join(sentence(r) for _ in range(3)))
            kinds = set()
            if k % 4 == 0:
                lines.insert(2, title if k % 8 else title.upper().replace("O", "0", 1))
                kinds.add("header")
            if k % 5 == 0:
                lines.insert(3, r.choice(["- 12 -", "Página 3 de 90", "pág. 7", "[14]", "xiv", "33"]))
                kinds.add("page_number")
            if k % 3 == 0 and (at := [i for i, x in enumerate(lines[:-1]) if x.endswith(" municipal") or "municipal " in x]):
                i = at[0]
                head, _, tail = lines[i].partition("municipal")
                lines[i : i + 1] = [head + "muni-", ("cipal" + tail).strip()]
                kinds.add("hyphen")
            text = "\n".join(lines)
            if k % 7 == 0:
                text = text.replace("quebrada", r.choice(["qiiebrada", "que6rada", "quebracla"]), 1)
                kinds.add("misread")
            rows.append((f"doc_partido_{place}_{d:04}_p{k:04}", f"doc_partido_{place}_{d:04}", text, None if k % 2 else "socio-\nambiental, (ver página 27 del anexo)", kinds))
    return rows


def test_kinds_of_noise(spark):
    rows = corpus()
    df = spark.createDataFrame([r[:4] for r in rows], "id string, doc string, a string, b string").withColumn("key", F.lit("x")).withColumn("field", F.lit(1))
    out = P.noise(df, "id", "doc", ["a", "b"], ["b"])
    found = {}
    for r in out.collect():
        assert r["field_name"] == "a", r
        found.setdefault(r["id"], set()).add(r["kind"])
    wrong = [(i, k, found.get(i, set())) for i, _, _, _, k in rows if found.get(i, set()) != k]
    assert not wrong, wrong[:3]


def test_repair_gives_continuous_paragraphs():
    titles = P.Titles([P.title_key("Plan de trabajo vecinal – Nerica", "doc_p_nerica_0001"), "x" * 9])
    text = "La junta hará obras de agua en los ba-\n\n- 4 -\n\nrrios con enfoque socio-\nambiental y una\nPLAN DE TRABAJ0 VECINAL – NERICA | 5\nposta de salud.\n\nOtra parte con una qiiebrada."
    body, header, page = P.repaired(P.prepared(text), "doc_p_nerica_0001", titles, P.Labels(), False)
    assert header and page
    fixed = P.paragraphs(body, {"socio-ambiental"}, {"qiiebrada": "quebrada"})
    assert fixed == "La junta hará obras de agua en los barrios con enfoque socio-ambiental y una posta de salud.\n\nOtra parte con una quebrada."


def test_no_noise_and_empty(spark):
    schema = "id string, doc string, a string"
    rows = [("1", None, None), ("2", "d", ""), ("3", "d", " \n "), ("4", "d", "Año base:\n2023\nMeta: 45%\nTexto."), (None, "d", "x-\ny"), ("5", "d", "a " * 50_000), ("5b", "d", "según la página 12 del plan, ver\npágina 27 del anexo")]
    out = P.noise(spark.createDataFrame(rows, schema), "id", "doc", ["a"])
    assert out.collect() == []
    out = P.noise(spark.createDataFrame([], schema), "id", "doc", ["a"])
    assert out.columns == ["id", "field_name", "kind"] and out.collect() == []


def test_repaired_fields(spark):
    rows = corpus()
    df = spark.createDataFrame([r[:4] for r in rows], "id string, doc string, a string, b string").withColumn("body", F.lit("x"))
    got = {(r["id"], r["field_name"]): r["repaired"] for r in P.repaired_fields(df, "id", "doc", ["a", "b"], ["b"]).collect()}
    assert len(got) == sum((r[2] is not None) + (r[3] is not None) for r in rows)
    for i, _, _, b, _ in rows:
        text = got[i, "a"]
        assert "vecinal" not in text.lower() and "muni-" not in text and "qii" not in text and "\n" not in text
        assert all(part == part.strip() and part.startswith("Para los vecinos") and part.endswith("socio-ambiental") for part in text.split(". ")[:1] + [text.rstrip(".").split(". ")[-1]])
        if b:
            assert got[i, "b"] == "socio-ambiental, (ver página 27 del anexo)"


def test_misread_statement_under_many_ids(spark):
    r = random.Random(4)
    rows = [(f"p{i:03}", f"doc_partido_nerica_{i % 9:04}", f"Acta {i}: " + sentence(r)) for i in range(120)]
    copy = sentence(r).replace("quebrada", "qiiebrada")
    rows += [(f"q{i:03}", f"doc_partido_sapaqui_{i % 5:04}", copy if i % 2 else copy.replace(" ", "\n", 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, doc string, a string")
    found = {(x["id"], x["kind"]) for x in P.noise(df, "id", "doc", ["a"]).collect()}
    assert found == {(f"q{i:03}", "misread") for i in range(60)}
    fixed = {x["id"]: x["repaired"] for x in P.repaired_fields(df, "id", "doc", ["a"]).collect()}
    assert {fixed[f"q{i:03}"] for i in range(60)} == {copy.replace("qiiebrada", "quebrada")}


def test_titles_are_all_kept_however_many(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices(["ta", "mu", "ni", "ra", "con", "pa", "do", "su"], k=5))
    plans = [(f"doc_partido_{word()}_{i:04}", f"Cuaderno vecinal {word()} {word()}") for i in range(2100)]
    titles = [(d, f"{t} de {d.split('_')[2].title()}") for d, t in plans]
    texts = spark.createDataFrame([(d, f"Se reparará la\n{t}\nposta {k}.") for d, t in titles for k in range(3)], "doc string, text string")
    keys = {x["title"] for x in P.running_titles(texts).collect()}
    assert len(keys) > 2000 and {P.title_key(t, d) for d, t in titles} <= keys
    own = {x["doc"]: x["titles"] for x in P.titles_by_plan(texts).collect()}
    assert max(map(len, own.values())) <= 3  # a plan gets its own titles, not all
    for d, t in titles[::50]:
        text = f"Se reparará la\n{t.upper().replace('O', '0')}\nposta."
        assert [text[a:z] for a, z in P.Titles(own[d]).spans(text, d)] == [t.upper().replace("O", "0")]


def test_wide_title_and_title_only_within_lines(spark):
    title = "Plan de gobierno municipal concertado y participativo de la agrupación de vecinos independientes unidos por el progreso de Nerica"
    rows = [(f"doc_a_nerica_{i:04}", f"Se hará la obra número {i} de la\n{title}\nposta vecinal del barrio.") for i in range(4)]
    rows += [("doc_a_nerica_0009", f"Se hará la obra {title.upper()} de agua.")]
    df = spark.createDataFrame([(f"k{i}", d, t) for i, (d, t) in enumerate(rows)], "id string, doc string, a string")
    assert {(x["id"], x["kind"]) for x in P.noise(df, "id", "doc", ["a"]).collect()} == {(f"k{i}", "header") for i in range(5)}


def states(text):
    lines = P.lines_of(P.prepared(text), "d", P.Titles([]), False)
    return {line: (P.FORMS[seen[0]], P.STATES[s]) for (line, seen, _), s in zip(lines, P.Labels().path([x for _, x, _ in lines]))}


def test_path_overrules_a_form():
    """The same bare number is a page mark between lines that read on, and an entry in a column of numbers."""
    prose = "La junta vecinal construirá las obras de agua en los\n33\nbarrios altos del distrito con el presupuesto de la\nmunicipalidad y la mano de obra de los vecinos."
    column = "La junta vecinal construirá las obras de agua en los anexos.\nMeta:\n12\n33\n41\n8\nLa municipalidad pondrá la mano de obra y los materiales de las obras."
    assert states(prose)["33"] == ("bare", "page")
    assert states(column)["33"] == ("bare", "entry")
    assert P.repaired(P.prepared(column), "d", P.Titles([]), P.Labels(), False)[2] is False


def test_layout_alone_changes_the_path():
    """With its layout tables made flat the model reads the column's numbers as it would by their form."""
    import numpy as np

    flat = P.Labels()
    flat = P.Labels([*flat.tables[:2], *(np.full_like(t, 1 / t.shape[1]) for t in flat.tables[2:])])
    lines = P.lines_of("Los vecinos pondrán la mano de obra y los materiales de la\n12\n33\nobra del barrio alto y del barrio bajo de la ciudad vieja.", "d", P.Titles([]), False)
    shown = [x for _, x, _ in lines]
    assert P.Labels().path(shown) != flat.path(shown)


def test_other_scripts_stay():
    text = "el ángulo α y la densidad ρ; Москва 👩🏽\u200d🌾"
    assert P.prepared(text) == text
    assert P.prepared("la сasa\xa0азul у １２") == "la casa азul у １２".replace("азul", P.one_form("азul")).replace("у", "y").replace("１２", "12")


def test_many_texts_at_once_read_as_one_by_one():
    r = random.Random(8)
    model = P.Labels()
    texts = [[(r.randrange(len(P.FORMS)), *(r.randrange(n) for n in P.KINDS)) for _ in range(r.choice([1, 2, 7, 40]))] for _ in range(60)]
    assert [p.tolist() for p in model.paths(texts)] == [model.path(t) for t in texts]
    assert model.paths([]) == []
