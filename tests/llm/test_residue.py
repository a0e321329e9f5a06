import random
import re

import numpy as np
from pyspark.sql import functions as F

from hemiciclo.llm import residue as R
from hemiciclo.llm import residue_examples as X

r = random.Random(9)
PLACES = ["Tarapoma", "Quilahua", "Moyobe", "Nerica", "Sapaqui"]


def prose(k=4):
    forms = ["Financiar la posta de salud en la cuenca del {p}, con {n} camas hasta 20{n}.", "La meta es construir {n} aulas en el distrito de {p} y ampliar el mercado.", "El déficit de {n} % en {p} obliga a renovar la tubería de agua (meta {n}).", "Los vecinos de {p} contarán con una brigada de {n} agentes."]
    return " ".join(r.choice(forms).format(p=r.choice(PLACES), n=r.randrange(10, 99)) for _ in range(k))


# held out: none of these lines is a written example
RESIDUE = [
    "Error 503: la página que busca no está disponible en este servidor. Intente de nuevo más tarde.", "Please enable JavaScript and cookies to view this site.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit nulla mollis.", "asdf asdf qwerty test xxx asdf bla", "Haga clic para agregar texto aquí",
    prose(2) + " con {{presupuesto}} millones " + prose(2), prose(3) + " en [INSERTAR MUNICIPIO] " + prose(1), prose(2) + " <<OBJETIVO>> de la región. " + prose(2), prose(1) + "\nDD/MM/AAAA ${responsable}\n" + prose(2),
]
CLEAN = ["La página no encontrada en los registros de Tarapoma [4] será restituida por la vía.", "Un taller de JavaScript llegará a 12 brigadistas en Nerica.", "==========\n<|endoftext|>\n🌾🌾", "¡Sí! «La meta» [12] (acta 5)"]


def test_held_out_accuracy(spark):
    docs = [(i, prose()) for i in range(600)]
    docs += [(1000 + i, t) for i, t in enumerate(RESIDUE)] + [(2000 + i, prose() + "\n" + t) for i, t in enumerate(CLEAN)] + [(3000, None), (3001, ""), (3002, " \n"), (3003, prose(3000)), (3004, prose(2000) + " {{fecha}} " + prose(2000)), (3004, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("coverage", F.lit(1))
    found = {x[0] for x in R.with_residue(df, "doc_id", "text").collect()}
    hit = [i for i in range(len(RESIDUE)) if 1000 + i in found]
    assert len(hit) >= len(RESIDUE) - 1, hit
    assert 3004 in found and 3000 not in found and 3001 not in found and 3002 not in found
    assert len([d for d in found if d < 1000 or 2000 <= d < 3004]) <= 2
    scored = {x["doc_id"]: x for x in R.residue_scores(df, "doc_id", "text").collect() if x["doc_id"] in (1002, 3003)}
    assert scored[1002]["coverage"] > 0.5 and scored[3003]["coverage"] == 0
    assert R.with_residue(df.limit(0), "doc_id", "text").count() == 0


def test_windows_lie_on_the_residue():
    import numpy as np

    llr = np.array([-1.0] * 20 + [4.0] * 8 + [-1.0] * 60 + [5.0] * 6 + [-2.0] * 5)
    assert [w[:3] for w in R.windows(llr, np.array([0, 60]), 17.0)] == [(20, 28, 32.0), (88, 94, 30.0)]
    assert [w[:2] for w in R.windows(llr, np.array([0, 24]), 15.0)] == [(20, 24), (88, 94)]  # no window crosses the start of a unit


def test_wording_left_out_of_the_models():
    """Ten folds over the frames of all kinds: what the models of nine folds find of the tenth, and of prose."""
    prose_lines = [prose(1) for _ in range(1500)]
    found = total = 0
    for fold in range(10):
        held = {k: [f for i, f in enumerate(fs) if i % 10 == fold] for pack in (X.NOTICES, X.FILLER) for k, fs in pack.items() if k not in ("latin", "keys")}
        rest = [{k: [f for i, f in enumerate(fs) if i % 10 != fold or k in ("latin", "keys")] for k, fs in pack.items()} for pack in (X.FILLER, X.NOTICES)]
        models = [R.Model(X.lines(pack, 40, 5 + i)) for i, pack in enumerate(rest)]
        judge = R.Judge(models, R.Model(prose_lines, once=False), *R.written()[2:])
        score, _ = judge.scores(X.lines(held, 3, 50 + fold), 16.0)
        found, total = found + int((score >= 16).sum()), total + len(score)
        clean, _ = judge.scores([prose(3) for _ in range(60)], 16.0)
        assert (clean >= 16).sum() <= 1
    assert found / total > 0.75, found / total


def test_slots_of_other_names_and_natural_signs():
    judge = R.fitted([prose(3) for _ in range(300)])
    hit = lambda made: sum(bool(w) for w in judge.shape_windows(list(made), R.SLOT * R.THRESHOLD)) / 100
    slots, signs = list(X.placeholders(91)), list(X.naturals(92))
    assert 100 * hit(slots) / len(slots) > 0.88
    assert 100 * hit(signs) / len(signs) < 0.01


# in no written example, and a third of the documents each time
PAGES = ["Lo sentimos: el recurso solicitado no se encuentra en este servidor en este momento.", "Ocurrió un error inesperado al procesar su solicitud. Contacte al administrador del sitio (caso {n}a{n}).", "Este campo de texto debe ser reemplazado por el contenido final de la propuesta."]


def test_a_page_of_a_third_of_the_documents_is_found(spark):
    clean = [(i, prose()) for i in range(600)]
    for page in PAGES:
        alone = [(1000 + i, page.format(n=r.randrange(10, 99))) for i in range(150)]
        within = [(2000 + i, prose(1) + " " + page.format(n=r.randrange(10, 99)) + " " + prose(1)) for i in range(150)]
        found = {x[0] for x in R.with_residue(spark.createDataFrame(clean + alone + within, "doc_id long, text string"), "doc_id", "text").collect()}
        assert len([d for d in found if d >= 1000]) == 300, page
        assert len([d for d in found if d < 1000]) <= 2, page


def test_sample_has_each_text_once(spark):
    df = spark.createDataFrame([("a",)] * 500 + [(f"t{i}",) for i in range(300)], "text string")
    assert sorted(R.distinct_sample(df, "text", 1000)) == sorted(["a"] + [f"t{i}" for i in range(300)])
    drawn = R.distinct_sample(df, "text", 100)
    assert len(drawn) == len(set(drawn)) == 100 and drawn == R.distinct_sample(df, "text", 100)


def test_models_are_fitted_on_all_texts(spark):
    """Equal to the fit in one place; more texts than the former sample of 4,000, one of them of over 20,000 characters."""
    import numpy as np

    texts = [f"{prose(1)} Nota de {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}." for i in range(4500)] + [prose(400) + " único"]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None, ""]], "text string")
    got, want = R.fitted_on_all(df, "text"), R.fitted(sorted(texts))
    for a, b in ((got.prose, want.prose), (got.natural, want.natural)):
        # which of the passages of one form stands for it may differ, and with it only the digits
        assert abs(a.total - b.total) <= 0.001 * b.total
        assert all(np.abs(x - y).sum() <= 0.01 * y.sum() for x, y in zip(a.counts[:3], b.counts[:3]))


def test_no_example_is_a_line_of_a_table():
    """But the reason phrases of HTTP, which are a public list."""
    import re
    from pathlib import Path

    import pyarrow.parquet as pq
    import pytest

    table = Path("/root/testdata/sf0.01/documents.parquet")
    if not table.exists():
        pytest.skip("no test tables")
    bare = lambda x: re.sub(r"\d", "0", x.lower().strip(" \t\n*•-.!"))
    texts = [t for t in pq.read_table(table, columns=["text"])["text"].to_pylist() if t]
    held = {bare(x) for t in texts for x in [*t.split("\n"), *(p for _, p in R.passages(t))]}
    made = {bare(x) for pack in (X.NOTICES, X.FILLER) for x in X.lines(pack, 40, 3)}
    public = {f"000 {phrase}" for phrase in X.REASONS.values()}
    assert not (made & held) - public, (made & held) - public


def test_each_passage_is_turned_into_ngrams_once(monkeypatch):
    own = [f"Se construirá el hospital número {i} en la provincia de Tarma, con personal propio." for i in range(60)] + ["You need to enable JavaScript to run this app. Please enable JavaScript in your browser.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."]
    often, mixed = np.zeros(len(own), dtype=bool), R.Model(own[:60])
    left = [p for p, d in zip(own, R.doubted(own, often, mixed)) if not d]
    assert own[:60] == left
    filler, notices, slots, natural = R.written()
    prose, shapes, want = ([np.zeros(1 << bits, dtype=np.int64) for bits in R.SIZES] for _ in range(3))
    R.add_counts(want, R.characters(left))
    read, grams = [], R.grams
    monkeypatch.setattr(R, "grams", lambda codes: read.append(len(codes)) or grams(codes))
    R.count_prose(own, often, R.Judge([], mixed, slots, natural), (filler, notices), prose, shapes)
    assert read == [len(R.characters(own))]
    assert all((a == b).all() for a, b in zip(prose, want)) and not shapes[0].any()


def test_fast_forms_say_the_same():
    """Passages, forms and the look for placeholders against the plain expressions."""
    passage, signs, percent = re.compile(r"(?<=[.!?…])(?=\s)|(?<=\n)"), re.compile(r"[\[\]{}<>#@«»_~|$^]|\.\.\. ?\(|…\(|/\*|\*\w|--"), re.compile(r"(?<![\d ])%|%[\w(]")
    dice, letters = random.Random(3), [*"ab1 .!?…\n%(*-/:_\r ", "lorem", "...", "--", "todo ", "nan", "İ"]
    for _ in range(20_000):
        t = "".join(dice.choice(letters) for _ in range(dice.randrange(14)))
        parts = [p for p in passage.split(t) if p]
        assert [p for _, p in R.passages(t)] == parts
        forms = {}
        for p in parts:
            if form := " ".join("0" if R.VARIES.search(w) else w for w in p.lower().split()):
                forms.setdefault(form, p)
        assert R.forms_of(t) == forms
        assert R.probed(t) == bool(signs.search(t) or percent.search(t) or R.ASKED.search(t) or R.VOID.search(t.lower()))
