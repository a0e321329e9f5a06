"""Queries of the text and rule operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import rules as R
from hemiciclo.functions import text as T
from hemiciclo.operators import groups, segment
from hemiciclo.plans.registry import Registry
from hemiciclo.session import spread, table

registry = Registry()
query = registry.query


# --- the same rules in SQL, made from the same packs
def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{T.MARKED}', '{T.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


def sql_squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_count(x: str, key: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {quoted(key)}, ''))) / {len(key)} AS INT)"


def sql_topics(x: str) -> str:
    return "[" + ", ".join(f"{{'n': {' + '.join(sql_count(x, k) for k in keys)}, 'o': {-i}, 'axis': {quoted(a)}}}" for i, (a, keys) in enumerate(lex.AXES.items())) + "]"


def sql_class(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN {quoted(n)}" for n, p in lex.INSTRUMENTS) + " ELSE 'unspecified' END"


def sql_tags(x: str, keys: list[str]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({x}, {quoted(k)}) THEN {quoted(k)} END" for k in keys)
    return f"nullif(array_to_string(list_filter([{hits}], lambda k: k IS NOT NULL), '; '), '')"


def sql_has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


# written out, not taken from the pack, so that a slip in the pack shows
SQL_NUMBER = r"\b\d+[\d\.,]*%?\b"
SQL_COST = r"s/\.?|soles|millones|miles de millones|presupuesto|costo|gasto"
QUANT = r"(regexp_matches(t, '\b\d+[\d\.,]*\b') AND regexp_matches(t, '%|por ciento|meta|al\s+\d+|hasta\s+\d+|millones|miles|pbi|ratio'))"
HORIZON = r"regexp_matches(t, '\b20\d{2}(?:\s*[-–]\s*20\d{2})?\b|\b\d+\s*(d[ií]as|meses|a[ñn]os)\b|corto plazo|mediano plazo|largo plazo|en 100 d[ií]as')"
FEATURES = f"""
    list_reverse_sort({sql_topics('t')})[1] AS best, list_sum(list_transform({sql_topics('t')}, lambda h: h.n)) AS hits,
    CASE WHEN t IS NOT NULL THEN {sql_class('t')} ELSE 'unspecified' END AS instrument, {sql_tags('t', lex.POPULATIONS)} AS population, {sql_tags('t', lex.TERRITORIES)} AS territory,
    nullif(regexp_extract(t, {quoted('(' + lex.EVIDENCE + ')')}, 1), '') AS evidence, {QUANT} AS quant, {HORIZON} AS horizon, {sql_has('t', SQL_COST)} AS cost, {sql_has('t', lex.FUNDING)} AS funding,
    ({sql_has('t', lex.VAGUE)} AND NOT {QUANT} AND NOT {HORIZON} AND {sql_class('t')} = 'unspecified') AS vague"""
SCORE = """greatest(0, least(100, CASE WHEN quant THEN 20 ELSE 0 END + CASE WHEN horizon THEN 15 ELSE 0 END + CASE WHEN instrument <> 'unspecified' THEN 15 ELSE 0 END + CASE WHEN population IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN territory IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN cost OR funding THEN 10 ELSE 0 END + CASE WHEN evidence IS NOT NULL THEN 10 ELSE 0 END - CASE WHEN vague THEN 10 ELSE 0 END))"""
ANNOTATED = f"""WITH base AS (SELECT *, lower(text) AS t FROM documents), features AS (SELECT *, {FEATURES} FROM base),
    scored AS (SELECT *, CASE WHEN hits > 0 THEN best.axis ELSE 'otros' END AS topic, CASE WHEN hits > 0 THEN best.n / hits ELSE 0.0 END AS confidence, {SCORE} AS score FROM features)"""


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "axis", "section_guess"))


@query(ANNOTATED + """, rolled AS (SELECT coalesce(source, '(none)') AS source, topic AS a, grouping(topic) AS g, count(*) AS statements_n, round(avg(score), 6) AS avg_score, round(avg(quant::INT), 6) AS pct_quant, round(avg(horizon::INT), 6) AS pct_horizon,
    round(avg(cost::INT), 6) AS pct_cost, round(avg(funding::INT), 6) AS pct_funding, round(avg((evidence IS NOT NULL)::INT), 6) AS pct_evidence FROM scored GROUP BY GROUPING SETS ((coalesce(source, '(none)'), topic), (coalesce(source, '(none)'))))
    SELECT source, CASE WHEN g = 1 THEN 'overall' ELSE a END AS axis, statements_n, round(statements_n / max(CASE WHEN g = 1 THEN statements_n END) OVER (PARTITION BY source), 6) AS axis_share, avg_score, pct_quant, pct_horizon, pct_cost, pct_funding, pct_evidence FROM rolled""")  # fmt: skip
def group_scores_rollup(spark, sf_dir):
    df = R.annotated(documents(spark, sf_dir).select("source", "text"), "text").withColumn("axis", F.col("topic.axis"))
    return groups.group_scores(df, "source", "axis")


@query(ANNOTATED + " SELECT doc_id, topic AS axis, round(confidence, 6) AS confidence FROM scored")
def axis_detect(spark, sf_dir):
    t = R.topic(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", "t.axis", F.round("t.confidence", 6).alias("confidence"))


@query(ANNOTATED + " SELECT doc_id, instrument, population, territory, evidence FROM scored")
def instrument_and_tags(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", R.first_class(t).alias("instrument"), R.tags(t, lex.POPULATIONS).alias("population"), R.tags(t, lex.TERRITORIES).alias("territory"), R.first_match(t).alias("evidence"))


@query(f"SELECT doc_id, nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(text, {quoted(SQL_NUMBER)}))), ';'), '') AS numbers FROM documents")
def numbers_found(spark, sf_dir):
    """Distinct numbers of a text; sorted here, since the twin has no order for distinct lists."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({lex.NUMBER})"), 1)))
    return documents(spark, sf_dir).select("doc_id", F.nullif(F.array_join(found, ";"), F.lit("")).alias("numbers"))


@query(ANNOTATED + " SELECT doc_id, quant, horizon, cost, funding, vague, score FROM scored")
def flags_and_score(spark, sf_dir):
    return R.annotated(documents(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "quant", "horizon", "cost", "funding", "vague", "score")


@query(ANNOTATED + """, marked AS (SELECT *, len(regexp_extract_all(text, '\\p{L}+')) >= 10 AND (instrument <> 'unspecified' OR quant OR horizon) AS strict FROM scored WHERE source IS NOT NULL AND text IS NOT NULL)
    SELECT source, count(*) AS detected, count(*) FILTER (WHERE strict) AS strict_n, round(count(*) FILTER (WHERE strict) / count(*), 6) AS pct_strict FROM marked GROUP BY source""")
def strict_by_group(spark, sf_dir):
    df = R.annotated(documents(spark, sf_dir).where("source IS NOT NULL AND text IS NOT NULL").select("source", "text"), "text")
    strict = (T.token_count(F.col("text")) >= 10) & ((F.col("instrument") != "unspecified") | F.col("quant") | F.col("horizon"))
    return df.groupBy("source").agg(F.count("*").alias("detected"), F.count_if(strict).alias("strict_n"), F.round(F.count_if(strict) / F.count("*"), 6).alias("pct_strict"))


@query(f"""SELECT doc_id, {sql_fold('text')} AS folded, replace({sql_fold('section_guess')}, ' ', '-') AS section_slug, 'doc_' || replace({sql_fold('source')}, ' ', '_') AS source_id,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{a0}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS normalized,
    len(regexp_extract_all(text, '\\p{{L}}+')) AS tokens_n FROM documents""")
def text_normalisers(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.folded(t).alias("folded"), T.slug(F.col("section_guess")).alias("section_slug"), T.doc_id(F.col("source")).alias("source_id"), T.normalized(t).alias("normalized"), T.token_count(t).cast("long").alias("tokens_n"))


LINES = """WITH lines AS (SELECT doc_id, i, """ + sql_squish("l") + """ AS l FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS x FROM documents))
    WHERE """ + sql_squish("l") + """ <> ''), heads AS (SELECT *, length(l) BETWEEN 4 AND 140 AND (regexp_matches(l, '^([0-9]+([.][0-9]+)*|[IVXLCM]+)[.)-]?\\s+[A-ZÁÉÍÓÚÑ].+') OR (l = upper(l) AND regexp_matches(l, '[A-ZÁÉÍÓÚÑ]'))
    OR (regexp_matches(l, '^[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚáéíóúÑñÜü ]{3,80}$') AND length(l) - length(replace(l, ' ', '')) <= 8)) AS head FROM lines),
    numbered AS (SELECT *, 1 + sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section_id FROM heads),
    parts AS (SELECT doc_id, section_id, coalesce(max(CASE WHEN head THEN left(l, 100) END), 'INTRODUCCION') AS section_guess, string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT head) AS section_text FROM numbered GROUP BY doc_id, section_id)"""


@query(LINES + " SELECT doc_id, CAST(section_id AS INT) AS section_id, section_guess, section_text FROM parts WHERE section_text <> ''")
def section_split(spark, sf_dir):
    return segment.sections(documents(spark, sf_dir), "doc_id", "text")


CANDIDATES = LINES + """, bullets AS (SELECT doc_id, section_id, section_guess, 0 AS kind, i, """ + sql_squish("regexp_replace(l, '^\\s*(?:[-•*]|[0-9]+[.)]|[a-zA-Z]\\))\\s+', '')") + """ AS c FROM (SELECT doc_id, section_id, section_guess, unnest(string_split(section_text, chr(10))) AS l, generate_subscripts(string_split(section_text, chr(10)), 1) AS i FROM parts WHERE section_text <> '')
    WHERE regexp_matches(l, '^\\s*(?:[-•*]|[0-9]+[.)]|[a-zA-Z]\\))\\s+')), said AS (SELECT doc_id, section_id, section_guess, 1 AS kind, i, """ + sql_squish("l") + """ AS c FROM (SELECT doc_id, section_id, section_guess, unnest(string_split(x, chr(1))) AS l, generate_subscripts(string_split(x, chr(1)), 1) AS i
    FROM (SELECT *, regexp_replace(section_text, '([.!?…])\\s+', '\\1' || chr(1), 'g') AS x FROM parts WHERE section_text <> ''))), acting AS (SELECT * FROM said WHERE regexp_matches(lower(c), '(^|[^\\p{L}])(""" + "|".join(lex.ACTIONS) + """)')),
    cands AS (SELECT doc_id, section_id, section_guess, c, min((kind, i)) AS place FROM (SELECT * FROM bullets UNION ALL SELECT * FROM acting) GROUP BY ALL HAVING length(c) BETWEEN 35 AND 800)"""


@query(CANDIDATES + """, ids AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, place) AS n, len(regexp_extract_all(c, '\\p{L}+')) AS tokens_n FROM cands), firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY n) AS copy FROM ids WHERE tokens_n >= 6)
    SELECT 'doc_' || doc_id || '_p' || lpad(n::VARCHAR, 4, '0') AS statement_id, doc_id, CAST(section_id AS INT) AS section_id, section_guess, c AS statement, CAST(tokens_n AS INT) AS tokens_n FROM firsts WHERE copy = 1""")
def statement_candidates(spark, sf_dir):
    return segment.statements(documents(spark, sf_dir), "doc_id", "text")


@query("""WITH d AS (SELECT DISTINCT proposal_id, proposal_text AS s, source_snippet AS x FROM propuestas WHERE proposal_text IS NOT NULL AND source_snippet IS NOT NULL), k AS (SELECT *, left(lower(""" + sql_squish("s") + """), 120) AS key FROM d), p AS (SELECT *, strpos(lower(x), key) AS f FROM k)
    SELECT proposal_id, CASE WHEN f = 0 THEN left(""" + sql_squish("s") + """, 100) ELSE substr(x, greatest(1, f - 50), least(length(x), f + length(key) - 1 + 50) - greatest(1, f - 50) + 1) END AS snippet FROM p""")
def snippet_window(spark, sf_dir):
    d = table(spark, sf_dir, "propuestas").select("proposal_id", "proposal_text", "source_snippet").where("proposal_text IS NOT NULL AND source_snippet IS NOT NULL").distinct()
    return d.select("proposal_id", T.snippet(F.col("source_snippet"), F.col("proposal_text"), 50).alias("snippet"))


@query()
def page_cleaning(spark, sf_dir):
    """Pages of a plan (here: the sections of a source) without what repeats on them; checked on fixtures."""
    pages = documents(spark, sf_dir).select(F.concat_ws("/", "source", "axis").alias("doc"), F.col("doc_id").alias("page_no"), "text")
    return segment.clean_pages(pages)


@query(f"""WITH b AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, unnest(regexp_extract_all(t, {quoted(R.AMOUNT)}, 1)) AS n, unnest(regexp_extract_all(t, {quoted(R.AMOUNT)}, 2)) AS u FROM b WHERE regexp_matches(t, {quoted(R.MONEY)})),
    v AS (SELECT doc_id, try_cast(CASE WHEN contains(n, ',') THEN replace(replace(n, '.', ''), ',', '.') WHEN length(n) - length(replace(n, '.', '')) > 1 THEN replace(n, '.', '') ELSE n END AS DOUBLE) * CASE WHEN starts_with(u, 'mil ') THEN 1e9 WHEN u = 'millones' THEN 1e6 WHEN u = 'miles' THEN 1e3 ELSE 1 END AS v FROM n)
    SELECT doc_id, count(v) AS amounts_n, round(max(v), 2) AS largest FROM v WHERE v > 0 GROUP BY doc_id""")
def amount_extract(spark, sf_dir):
    a = R.amounts(F.col("text"))
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", a.alias("a")).where(F.size("a") > 0).select("doc_id", F.size("a").cast("long").alias("amounts_n"), F.round(F.array_max("a"), 2).alias("largest"))


COVERED = "WITH base AS (SELECT coalesce(party, '(none)') AS party, " + sql_fold("coalesce(proposal_text, '')") + " AS t FROM (SELECT DISTINCT proposal_id, party, proposal_text FROM propuestas)), sized AS (SELECT party, count(*) AS statements_n FROM base GROUP BY party), covered AS (" + " UNION ALL ".join(
    f"SELECT party, '{dim}' AS dim, '{g}' AS coverage_group, count(*) AS statements_n, count(*) FILTER (WHERE {' OR '.join(f'contains(t, {quoted(k)})' for k in keys)}) AS covered_n FROM base GROUP BY party" for dim, pack in lex.COVERAGE.items() for g, keys in pack.items()
) + ")"


def covered(spark, sf_dir):
    rows = table(spark, sf_dir, "propuestas").select("proposal_id", F.coalesce("party", F.lit("(none)")).alias("party"), "proposal_text").distinct()
    return groups.coverage(rows, "party", "proposal_text")


@query(COVERED + " SELECT * FROM covered")
def coverage_group(spark, sf_dir):
    return covered(spark, sf_dir)


@query(COVERED + " SELECT party, dim, coverage_group, round(covered_n / statements_n, 6) AS coverage_share, CASE WHEN covered_n = 0 THEN 'sin_cobertura' WHEN covered_n / statements_n < 0.03 THEN 'muy_baja' WHEN covered_n / statements_n < 0.08 THEN 'baja' ELSE 'cobertura_ok' END AS blindspot_flag FROM covered")
def coverage_blindspots(spark, sf_dir):
    return groups.blindspots(covered(spark, sf_dir))


@query(COVERED + " SELECT party, dim, max(statements_n) AS statements_n, count(*) FILTER (WHERE covered_n > 0) AS groups_covered_n, round(avg(covered_n / statements_n), 6) AS coverage_avg, round(min(covered_n / statements_n), 6) AS coverage_min FROM covered GROUP BY party, dim")
def coverage_summary(spark, sf_dir):
    return groups.coverage_summary(covered(spark, sf_dir))


def sql_stances(x: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{d}' AS dimension, CASE WHEN {sql_has(x, a)} THEN '{sa}' ELSE '{sb}' END AS stance FROM b WHERE {sql_has(x, a)} <> {sql_has(x, bb)}" for d, sa, sb, a, bb in lex.STANCES)


@query("WITH b AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) " + sql_stances("t"))
def stance_rules(spark, sf_dir):
    return groups.stance_hits(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id", "dimension", "stance")


SIDES = " ".join(f"WHEN '{sa}' THEN 'a' WHEN '{sb}' THEN 'b'" for _, sa, sb, _, _ in lex.STANCES)


@query(f"""WITH h AS (SELECT party, dimension, stance, proposal_id AS k, coalesce(signal, 0) AS s FROM hits WHERE party IS NOT NULL AND stance IS NOT NULL AND NOT coalesce(isnan(signal), false)), r AS (SELECT *, row_number() OVER (PARTITION BY party, dimension, stance ORDER BY s DESC, k) AS n, CASE stance {SIDES} END AS side FROM h)
    SELECT a.party, a.dimension, a.stance AS stance_a, a.k AS key_a, b.stance AS stance_b, b.k AS key_b, round(50 * (a.s + b.s), 4) AS contradiction_score FROM r a JOIN r b ON a.party = b.party AND a.dimension = b.dimension AND a.side = 'a' AND b.side = 'b' AND a.k <> b.k WHERE a.n = 1 AND b.n = 1""")
def contradiction_pairs(spark, sf_dir):
    hits = table(spark, sf_dir, "hits").where("stance IS NOT NULL AND NOT coalesce(isnan(signal), false)")
    return groups.contradictions(hits, "party", "proposal_id", "signal")


STOPS = "(" + ", ".join(quoted(w) for w in lex.STOPWORDS) + ")"


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS n FROM w WHERE term NOT IN {STOPS} GROUP BY ALL)
    SELECT doc_id, term, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS tf, round(n / sum(n) OVER (PARTITION BY doc_id) * ln((SELECT count(DISTINCT doc_id) FROM t) / count(*) OVER (PARTITION BY term)), 6) AS tf_idf FROM t""")
def tfidf_terms(spark, sf_dir):
    return groups.tfidf(documents(spark, sf_dir), "doc_id", "text", lex.STOPWORDS)
