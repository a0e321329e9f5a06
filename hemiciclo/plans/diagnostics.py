"""Queries of duplicates between parties, further rules and the report views built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import rules as R
from hemiciclo.functions import text as T
from hemiciclo.operators import copies, groups, search, vectors
from hemiciclo.plans.registry import Registry
from hemiciclo.plans.reports import NETWORK, P, SUPERVISED, axis_centroids, corpus, statements, supervised
from hemiciclo.plans.rules import quoted, sql_fold
from hemiciclo.session import spread, table

registry = Registry()
query = registry.query

# --- duplicates between parties
STOPS = sorted({*lex.STOPWORDS, *lex.PLAN_WORDS})
SQL_FORM = f"trim(regexp_replace(regexp_replace(regexp_replace({sql_fold('proposal_text')}, {quoted(lex.BOILERPLATE)}, ' ', 'g'), '\\b(on|oe) ?[0-9]+\\b', ' ', 'g'), ' +', ' ', 'g'))"
DUPLICATES = f"""WITH f AS (SELECT DISTINCT proposal_id AS k, party AS p, {SQL_FORM} AS form FROM propuestas WHERE proposal_id IS NOT NULL AND party IS NOT NULL AND proposal_text IS NOT NULL),
    v AS (SELECT proposal_id AS k, min(embedding) AS v FROM proposal_vectors WHERE embedding IS NOT NULL GROUP BY 1),
    t AS (SELECT f.k, f.p, v.v, list_sort(list_distinct(list_filter(string_split(form, ' '), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(quoted(w) for w in STOPS)}], w)))) AS t FROM f JOIN v USING (k)),
    reps AS (SELECT p, t, min(k) AS k, arg_min(v, k) AS v FROM t WHERE len(t) >= 8 GROUP BY p, t),
    met AS (SELECT a.k AS a, b.k AS b, a.p AS pa, b.p AS pb, list_cosine_similarity(a.v, b.v) AS c, len(list_intersect(a.t, b.t)) AS common, len(a.t) + len(b.t) AS total FROM reps a JOIN reps b ON a.k < b.k AND a.p <> b.p AND len(a.v) = len(b.v)),
    near AS (SELECT a, b, pa, pb, c, common / (total - common) AS j FROM met WHERE c >= 0.93 AND (common / (total - common) >= 0.65 OR (c >= 0.985 AND common / (total - common) >= 0.45))),
    x AS (SELECT form, p, min(k) AS k FROM f WHERE length(form) >= 80 GROUP BY ALL), h AS (SELECT form, min(k) AS head, arg_min(p, k) AS hp FROM x GROUP BY form HAVING count(*) > 1),
    exact AS (SELECT head AS a, k AS b, hp AS pa, p AS pb FROM x JOIN h USING (form) WHERE k <> head),
    links AS (SELECT a AS key_a, b AS key_b, pa AS party_a, pb AS party_b, 1.0 AS cosine, 1.0 AS jaccard, 'exact_duplicate' AS kind FROM exact UNION ALL SELECT a, b, pa, pb, c, j, 'near_duplicate' FROM near ANTI JOIN exact USING (a, b))"""


def raw(spark, d):
    return spread(table(spark, d, "propuestas").where("proposal_id IS NOT NULL AND party IS NOT NULL AND proposal_text IS NOT NULL").select("proposal_id", "party", "proposal_text"))


def formed(rows):
    # a filter isn't pushed below explode, which would make the form twice
    return rows.select("proposal_id", "party", F.explode(F.array(T.without_boilerplate(F.col("proposal_text"), lex.BOILERPLATE))).alias("form"))


def tokened(rows):
    return formed(rows).withColumn("tokens", F.filter(F.split("form", " "), lambda w: (F.length(w) >= 3) & ~w.isin(STOPS)))


def near(spark, d):
    v = table(spark, d, "proposal_vectors").select("proposal_id", "embedding")
    # each step makes forms anew of the rows that it needs: that is time, but kept texts would be disk
    return copies.near_links(raw(spark, d), "proposal_id", "party", "tokens", "embedding", vectors=v, prepared=tokened)


def links(spark, d):
    return copies.merged_links(copies.exact_links(formed(raw(spark, d)), "proposal_id", "party", "form"), near(spark, d))


@query(DUPLICATES + " SELECT a AS key_a, b AS key_b, pa AS party_a, pb AS party_b, round(c, 6) AS cosine, round(j, 6) AS jaccard FROM near")
def near_duplicates(spark, d):
    """Pairs of classes of equal token sets of different parties that are close both as vectors and as sets."""
    return near(spark, d).withColumns({"cosine": F.round("cosine", 6), "jaccard": F.round("jaccard", 6)})


@query(DUPLICATES + " SELECT key_a, key_b, party_a, party_b, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, kind FROM links")
def duplicate_pairs(spark, d):
    return links(spark, d).withColumns({"cosine": F.round("cosine", 6), "jaccard": F.round("jaccard", 6)})


@query()
def duplicate_matches(spark, d):
    """One-to-one matches of the statements of two parties by descending score; checked against brute force in tests."""
    pairs = links(spark, d).select(F.concat_ws("__", F.least("party_a", "party_b"), F.greatest("party_a", "party_b")).alias("party_pair"), "key_a", "key_b", (F.when(F.col("kind") == "exact_duplicate", 2.0).otherwise(1.0) + F.col("cosine") + F.col("jaccard")).alias("match_score"))
    return copies.one_to_one(pairs, ["party_pair"], "key_a", "key_b", "match_score").withColumn("match_score", F.round("match_score", 6))


@query(DUPLICATES + " SELECT least(party_a, party_b) || ' - ' || greatest(party_a, party_b) AS pair, count(*) AS duplicates_n FROM links GROUP BY pair ORDER BY duplicates_n DESC, pair LIMIT 15")
def view_duplicates_top(spark, d):
    """The 15 pairs of parties with most duplicates: a top-k report."""
    pair = F.concat_ws(" - ", F.least("party_a", "party_b"), F.greatest("party_a", "party_b"))
    return links(spark, d).groupBy(pair.alias("pair")).agg(F.count("*").alias("duplicates_n")).orderBy(F.desc("duplicates_n"), "pair").limit(15)


# --- further rules
def sql_chain(x: str, before, keep: str, after) -> str:
    when = lambda pack: " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN {quoted(n)}" for n, p in pack)
    kept = ", ".join(quoted(a) for a in lex.KEPT_AXES)
    return f"CASE {when(before)} WHEN {keep} IN ({kept}) THEN {keep} {when(after)} ELSE 'otros' END"


@query(f"SELECT proposal_id, {sql_chain('t', lex.NETWORK_BEFORE, 'axis_supervised', lex.NETWORK_AFTER)} AS axis_network FROM (SELECT proposal_id, axis_supervised, {sql_fold(chr(99) + 'oalesce(proposal_text, ' + chr(39) * 2 + ')')} AS t FROM {SUPERVISED})")
def axis_network_class(spark, d):
    p = spread(supervised(spark, d, "proposal_id", "axis_supervised", "proposal_text"))
    t = T.folded(F.coalesce(F.col("proposal_text"), F.lit("")))
    return p.select("proposal_id", R.bound(F.struct(t.alias("t"), F.col("axis_supervised").alias("a")), lambda x: R.reclassified(x["t"], lex.NETWORK_BEFORE, x["a"], lex.KEPT_AXES, lex.NETWORK_AFTER)).alias("axis_network"))


@query(f"SELECT axis_agenda, count(*) AS statements_n, count(DISTINCT party) AS parties_n FROM (SELECT party, {sql_chain('t', lex.AGENDA_BEFORE, 'a', lex.AGENDA_AFTER)} AS axis_agenda FROM (SELECT party, coalesce(nullif(axis, ''), 'otros') AS a, lower(coalesce(proposal_text, '')) AS t FROM {P})) GROUP BY axis_agenda")
def axis_agenda_class(spark, d):
    p = spread(statements(spark, d).select("party", F.coalesce(F.nullif("axis", F.lit("")), F.lit("otros")).alias("a"), F.lower(F.coalesce("proposal_text", F.lit(""))).alias("t")))
    agenda = R.reclassified(F.col("t"), lex.AGENDA_BEFORE, F.col("a"), lex.KEPT_AXES, lex.AGENDA_AFTER)
    return p.select("party", agenda.alias("axis_agenda")).groupBy("axis_agenda").agg(F.count("*").alias("statements_n"), F.count_distinct("party").alias("parties_n"))


SQL_PHRASE = "CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN {quoted(n)}" for n, p in lex.TOPIC_PHRASES) + " WHEN t = '' THEN 'Agenda programática prioritaria' ELSE upper(t[1]) || t[2:] END"


@query(f"SELECT topic_group, count(*) AS proposals_n, count(DISTINCT party) AS parties_n FROM (SELECT party, {SQL_PHRASE} AS topic_group FROM (SELECT party, lower(trim(regexp_replace(coalesce(section_guess, ''), '\\s+', ' ', 'g'))) AS t FROM {P})) GROUP BY topic_group ORDER BY proposals_n DESC, topic_group LIMIT 12")
def view_topics_regrouped(spark, d):
    """Labels regrouped by phrase, the 12 most frequent: a top-k report. The labels here are the statements' section headings."""
    p = statements(spark, d).select("party", R.topic_phrase(F.coalesce("section_guess", F.lit(""))).alias("topic_group"))
    return p.groupBy("topic_group").agg(F.count("*").alias("proposals_n"), F.count_distinct("party").alias("parties_n")).orderBy(F.desc("proposals_n"), "topic_group").limit(12)


@query(r"""SELECT proposal_id, CASE WHEN has_quant_target OR has_time_horizon THEN a OR o ELSE a AND o END AS seed FROM (SELECT DISTINCT proposal_id, has_quant_target, has_time_horizon,
    regexp_matches(lower(proposal_text), '(^|[^\p{L}\p{N}_])(crear|creara|crearan|implementar|implementara|fortalecer|fortalecera|reformar|reformara|aumentar|incrementar|reducir|eliminar|construir|promover|impulsar|garantizar|establecer|desarrollar|financiar|ampliar|modernizar|descentralizar|reorganizar|digitalizar|formalizar)[\p{L}\p{N}_]*') AS a,
    regexp_matches(lower(proposal_text), '(^|[^\p{L}\p{N}_])(se propone|se plantea|se establece|debe|deber[aá]n|se ejecutar[aá]|se crear[aá]|se implementar[aá])([^\p{L}\p{N}_]|$)') AS o FROM propuestas WHERE proposal_text IS NOT NULL)""")
def annotation_seed(spark, d):
    p = statements(spark, d).where("proposal_text IS NOT NULL")
    return p.select("proposal_id", R.seeded(F.col("proposal_text"), F.col("has_quant_target") | F.col("has_time_horizon")).alias("seed"))


@query(f"SELECT proposal_id, round(coalesce(concreteness_score, 0) / 100 * 0.5 + coalesce(axis_supervised_prob, 0) * 0.3 + coalesce(instrument_supervised_prob, 0) * 0.2, 6) AS signal FROM {SUPERVISED}")
def stance_signal(spark, d):
    p = supervised(spark, d)
    return p.select("proposal_id", F.round(R.signal(F.col("concreteness_score"), F.col("axis_supervised_prob"), F.col("instrument_supervised_prob")), 6).alias("signal"))


@query(f"""WITH b AS (SELECT proposal_id, lower(proposal_text) AS t FROM {P} WHERE proposal_text IS NOT NULL), n AS (SELECT proposal_id, unnest(regexp_extract_all(t, {quoted(R.AMOUNT)}, 1)) AS n, unnest(regexp_extract_all(t, {quoted(R.AMOUNT)}, 2)) AS u, generate_subscripts(regexp_extract_all(t, {quoted(R.AMOUNT)}, 1), 1) AS i FROM b WHERE regexp_matches(t, {quoted(R.MONEY)})),
    v AS (SELECT proposal_id, i, try_cast(CASE WHEN contains(n, ',') THEN replace(replace(n, '.', ''), ',', '.') WHEN length(n) - length(replace(n, '.', '')) > 1 THEN replace(n, '.', '') ELSE n END AS DOUBLE) * CASE WHEN starts_with(u, 'mil ') THEN 1e9 WHEN u = 'millones' THEN 1e6 WHEN u = 'miles' THEN 1e3 ELSE 1 END AS v FROM n),
    a AS (SELECT proposal_id, count(*) AS amounts_n, max(v) AS largest, list(CAST(round(v, 0) AS BIGINT)::VARCHAR ORDER BY i) AS l FROM v WHERE v > 0 GROUP BY 1)
    SELECT proposal_id, coalesce(amounts_n, 0) AS amounts_n, round(largest, 2) AS largest, array_to_string(l[1:5], ';') AS first_five, regexp_matches(t, 'regla fiscal|d[eé]ficit fiscal|deuda p[uú]blica|presi[oó]n tributaria|equilibrio fiscal|sostenibilidad fiscal|marco macro|mef') AS macro_anchor FROM b LEFT JOIN a USING (proposal_id)""")
def amount_details(spark, d):
    """Number of amounts, the largest, the first five in whole units, and whether a macroeconomic anchor is named."""
    p = spread(statements(spark, d).where("proposal_text IS NOT NULL").select("proposal_id", "proposal_text"))
    a = p.select("proposal_id", R.amounts(F.col("proposal_text")).alias("a"), R.has(F.col("proposal_text"), lex.MACRO_ANCHOR).alias("macro_anchor"))
    five = F.array_join(F.transform(F.slice("a", 1, 5), lambda v: F.round(v, 0).cast("long").cast("string")), ";")
    return a.select("proposal_id", F.size("a").cast("long").alias("amounts_n"), F.round(F.array_max("a"), 2).alias("largest"), F.when(F.size("a") > 0, five).alias("first_five"), "macro_anchor")


@query(f"SELECT proposal_id, CASE WHEN doc_id IS NULL OR doc_id = '' THEN 'doc_missing' ELSE doc_id END AS doc_id, CASE WHEN source_snippet IS NULL OR source_snippet = '' THEN left(proposal_text, 250) ELSE source_snippet END AS source_snippet, coalesce(nullif(axis, ''), nullif(axis_supervised, ''), 'otros') AS axis FROM {SUPERVISED}")
def traceability_defaults(spark, d):
    p = R.with_defaults(supervised(spark, d), "doc_id", "source_snippet", "proposal_text")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return p.select("proposal_id", "doc_id", "source_snippet", F.coalesce(blank("axis"), blank("axis_supervised"), F.lit("otros")).alias("axis"))


# --- joins and aggregates
@query(f"WITH p AS (SELECT DISTINCT proposal_id, party, axis FROM {P}), s AS (SELECT party, axis, count(*) AS supervised_n FROM {SUPERVISED} WHERE party IS NOT NULL AND axis IS NOT NULL GROUP BY ALL) SELECT p.proposal_id, p.party, p.axis, s.supervised_n FROM p LEFT JOIN s ON p.party = s.party AND p.axis = s.axis")
def left_join_two_keys(spark, d):
    s = supervised(spark, d).where("party IS NOT NULL AND axis IS NOT NULL").groupBy("party", "axis").agg(F.count("*").alias("supervised_n"))
    return statements(spark, d).select("proposal_id", "party", "axis").distinct().join(s, ["party", "axis"], "left").select("proposal_id", "party", "axis", "supervised_n")


@query(f"""WITH m AS (SELECT axis AS t, axis_supervised AS p, count(*) AS n FROM {SUPERVISED} WHERE axis IS NOT NULL AND axis_supervised IS NOT NULL GROUP BY ALL), k AS (SELECT t AS c FROM m UNION SELECT p FROM m),
    s AS (SELECT c, coalesce((SELECT sum(n) FROM m WHERE t = k.c), 0) AS sup, coalesce((SELECT sum(n) FROM m WHERE p = k.c), 0) AS pre, coalesce((SELECT sum(n) FROM m WHERE t = k.c AND p = k.c), 0) AS hit FROM k), f AS (SELECT *, CASE WHEN sup + pre > 0 THEN 2 * hit / (sup + pre) ELSE 0 END AS f1 FROM s)
    SELECT count(*) AS classes_n, CAST(sum(sup) AS BIGINT) AS rows_n, round(CASE WHEN sum(sup) > 0 THEN sum(hit) / sum(sup) ELSE 0 END, 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(CASE WHEN sum(sup) > 0 THEN sum(f1 * sup) / sum(sup) ELSE 0 END, 6) AS weighted_f1 FROM f""")
def overall_metrics(spark, d):
    return groups.overall_metrics(supervised(spark, d), "axis", "axis_supervised")


@query(f"SELECT party, count(*) FILTER (WHERE c AND NOT f) AS unfunded_n, count(*) FILTER (WHERE c) AS costed_n, round(CASE WHEN count(*) FILTER (WHERE c) > 0 THEN 100 * count(*) FILTER (WHERE c AND NOT f) / count(*) FILTER (WHERE c) ELSE 0 END, 6) AS unfunded_pct FROM (SELECT party, coalesce(mentions_cost, false) AS c, coalesce(mentions_funding_source, false) AS f FROM {P} WHERE party IS NOT NULL) GROUP BY party")
def costed_without_funding(spark, d):
    """Shares within a group, 0 where nothing is costed."""
    c, f = (F.coalesce(x, F.lit(False)) for x in ("mentions_cost", "mentions_funding_source"))
    p = statements(spark, d).where("party IS NOT NULL").groupBy("party").agg(F.count_if(c & ~f).alias("unfunded_n"), F.count_if(c).alias("costed_n"))
    return p.withColumn("unfunded_pct", F.round(F.when(F.col("costed_n") > 0, 100 * F.col("unfunded_n") / F.col("costed_n")).otherwise(0.0), 6))


# --- report views
@query(NETWORK + ", o AS (SELECT axis, group_i, group_j, s, row_number() OVER (PARTITION BY axis ORDER BY s DESC, group_i, group_j) AS n FROM edges WHERE s >= 0.72) SELECT axis, group_i, group_j, round(s, 6) AS similarity, CAST(n AS INT) AS place FROM o WHERE n <= 18")
def axis_network_top(spark, d):
    """The 18 strongest edges of each axis: a top-k report, kept by an aggregate before the rank is taken."""
    e = vectors.group_similarity(axis_centroids(spark, d), "party", "axis", 0.72, digits=None)
    return vectors.strongest(e, "axis", 18).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT count(DISTINCT party) AS parties_n, count(*) AS statements_n, round(100 * avg(has_quant_target::INT), 6) AS pct_quant, round(100 * avg(has_time_horizon::INT), 6) AS pct_horizon, round(avg(concreteness_score), 6) AS avg_score FROM {P} WHERE tokens_n >= 10 AND (coalesce(instrument_type, 'unspecified') <> 'unspecified' OR has_quant_target OR has_time_horizon)")
def view_strict_headline(spark, d):
    strict = (F.col("tokens_n") >= 10) & ((F.coalesce("instrument_type", F.lit("unspecified")) != "unspecified") | F.col("has_quant_target") | F.col("has_time_horizon"))
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 6)
    return statements(spark, d).where(strict).agg(F.count_distinct("party").alias("parties_n"), F.count("*").alias("statements_n"), pct("has_quant_target").alias("pct_quant"), pct("has_time_horizon").alias("pct_horizon"), F.round(F.avg("concreteness_score"), 6).alias("avg_score"))


PARTY_CENTRES = "WITH e AS (SELECT proposal_id, min(embedding) AS embedding FROM proposal_vectors WHERE embedding IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT proposal_id, party FROM propuestas WHERE party IS NOT NULL), v AS (SELECT party, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM e JOIN p USING (proposal_id)), m AS (SELECT party, pos, avg(x) AS x, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT party, list(x ORDER BY pos) AS v, max(n) AS n FROM m GROUP BY party HAVING max(n) >= 3), s AS (SELECT a.party AS x, b.party AS y, round(list_cosine_similarity(a.v, b.v), 6) AS s, round(sqrt((a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2), 6) AS d FROM c a JOIN c b ON a.party < b.party)"


def party_pairs(spark, d):
    e = table(spark, d, "proposal_vectors").where("embedding IS NOT NULL").groupBy("proposal_id").agg(F.min("embedding").alias("embedding"))
    p = table(spark, d, "propuestas").where("party IS NOT NULL").select("proposal_id", "party").distinct()
    c = vectors.centroids(e.join(p, "proposal_id"), ["party"], "embedding", least=3)
    return vectors.pairs_of_groups(c, "party")


@query(PARTY_CENTRES + " SELECT * FROM (SELECT 'nearest' AS kind, x AS party_a, y AS party_b, s AS value FROM s ORDER BY s DESC, x, y LIMIT 1) UNION ALL SELECT * FROM (SELECT 'farthest', x, y, d FROM s ORDER BY d DESC, x, y LIMIT 1)")
def view_extreme_pairs(spark, d):
    """The most similar pair of parties, and the two farthest apart on the map of the first two dimensions."""
    pairs = party_pairs(spark, d)
    flat = F.sqrt(F.pow(F.get("ci", F.lit(0)) - F.get("cj", F.lit(0)), 2) + F.pow(F.get("ci", F.lit(1)) - F.get("cj", F.lit(1)), 2))
    both = pairs.select("group_i", "group_j", F.round(vectors.cosine(F.col("ci"), F.col("cj")), 6).alias("s"), F.round(flat, 6).alias("d"))
    best = both.agg(*(F.min(F.struct((-F.col(c)).alias("far"), "group_i", "group_j")).alias(c) for c in ("s", "d")))
    rows = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("b")) for kind, c in (("nearest", "s"), ("farthest", "d"))))
    return best.select(F.explode(rows).alias("r")).where("r.b IS NOT NULL").select("r.kind", F.col("r.b.group_i").alias("party_a"), F.col("r.b.group_j").alias("party_b"), (-F.col("r.b.far")).alias("value"))


SIDES = " ".join(f"WHEN '{sa}' THEN 'a' WHEN '{sb}' THEN 'b'" for _, sa, sb, _, _ in lex.STANCES)


@query(f"""WITH h AS (SELECT party, dimension, stance, proposal_id AS k, coalesce(signal, 0) AS s FROM hits WHERE party IS NOT NULL AND stance IS NOT NULL AND NOT coalesce(isnan(signal), false)), r AS (SELECT *, row_number() OVER (PARTITION BY party, dimension, stance ORDER BY s DESC, k) AS n, CASE stance {SIDES} END AS side FROM h),
    c AS (SELECT a.party, 50 * (a.s + b.s) AS score FROM r a JOIN r b ON a.party = b.party AND a.dimension = b.dimension AND a.side = 'a' AND b.side = 'b' AND a.k <> b.k WHERE a.n = 1 AND b.n = 1) SELECT party, count(*) AS contradictions_n, round(avg(score), 4) AS avg_score FROM c GROUP BY party""")
def view_contradiction_totals(spark, d):
    hits = table(spark, d, "hits").where("stance IS NOT NULL AND NOT coalesce(isnan(signal), false)")
    return groups.contradictions(hits, "party", "proposal_id", "signal", digits=None).groupBy("party").agg(F.count("*").alias("contradictions_n"), F.round(F.avg("contradiction_score"), 4).alias("avg_score"))


@query(f"""WITH n AS (SELECT DISTINCT doc_id, party FROM {P} WHERE doc_id IS NOT NULL), s AS (SELECT DISTINCT doc_id, party FROM {SUPERVISED} WHERE doc_id IS NOT NULL), b AS (SELECT doc_id, min(party) AS party FROM n GROUP BY doc_id), c AS (SELECT doc_id, min(party) AS party FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(b.party, c.party, 'sin nombre') AS party, b.doc_id IS NOT NULL AND c.doc_id IS NOT NULL AS in_both, replace(doc_id, '_', '-') || '.pdf' AS href FROM b FULL JOIN c USING (doc_id)""")
def view_plan_catalogue(spark, d):
    """Every plan of either batch with the first name that is known of it."""
    one = lambda df, name: df.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("party").alias(name)).withColumn(f"in_{name}", F.lit(True))
    both = one(statements(spark, d), "b").join(one(supervised(spark, d), "c"), "doc_id", "full")
    return both.select("doc_id", F.coalesce("b", "c", F.lit("sin nombre")).alias("party"), (F.col("in_b").isNotNull() & F.col("in_c").isNotNull()).alias("in_both"), F.concat(F.replace("doc_id", F.lit("_"), F.lit("-")), F.lit(".pdf")).alias("href"))


# --- search with filters and an answer
QUESTION = "Agua potable en la zona rural"
SEARCHED = ["proposal_id", "party", "axis", "proposal_text", "source_snippet", "instrument_type", "concreteness_score", "has_quant_target", "has_time_horizon"]


def sql_search(distinct: bool) -> str:
    q = search.fold_query(QUESTION)
    words = [w for w in (dict.fromkeys(q.split()) if distinct else q.split()) if len(w) >= 2]
    return f"round(CASE WHEN contains(corpus, {quoted(q)}) THEN 8.0 ELSE 0 END + " + " + ".join(f"CASE WHEN contains(corpus, {quoted(w)}) THEN 2.2 ELSE 0 END" for w in words) + " + concreteness_score / 30 + CASE WHEN has_quant_target THEN 0.8 ELSE 0 END + CASE WHEN has_time_horizon THEN 0.8 ELSE 0 END, 6)"


FOUND = f"SELECT *, {sql_fold('concat_ws(chr(32), party, axis, proposal_text, source_snippet, instrument_type)')} AS corpus FROM (SELECT DISTINCT {', '.join(SEARCHED)} FROM propuestas)"


@query(f"SELECT proposal_id, search_score FROM (SELECT *, {sql_search(False)} AS search_score FROM ({FOUND}) WHERE axis = 'ambiente') WHERE search_score > 1.7 ORDER BY search_score DESC, concreteness_score DESC NULLS LAST, proposal_id LIMIT 24 OFFSET 24")
def search_page(spark, d):
    """The second page of hits of one axis: paging is the feature."""
    return search.page(corpus(spark, d), "proposal_id", QUESTION, "corpus", "concreteness_score", "has_quant_target", "has_time_horizon", 2, where={"axis": "ambiente"}).select("proposal_id", "search_score")


ANSWERED = f"WITH h AS (SELECT party, axis FROM (SELECT *, {sql_search(True)} AS search_score FROM ({FOUND})) ORDER BY search_score DESC, concreteness_score DESC NULLS LAST, has_quant_target DESC NULLS LAST, has_time_horizon DESC NULLS LAST, proposal_id LIMIT 50)"


@query(ANSWERED + " SELECT * FROM (SELECT 'party' AS kind, party AS name, count(*) AS hits_n FROM h WHERE party IS NOT NULL GROUP BY party ORDER BY hits_n DESC, party LIMIT 3) UNION ALL SELECT * FROM (SELECT 'axis', axis, count(*) AS hits_n FROM h WHERE axis IS NOT NULL GROUP BY axis ORDER BY hits_n DESC, axis LIMIT 2)")
def search_answer(spark, d):
    hits = search.top(corpus(spark, d), "proposal_id", QUESTION, "corpus", "concreteness_score", "has_quant_target", "has_time_horizon", 50)
    return search.answer(hits, "party", "axis")


@query(f"SELECT proposal_id, try_cast(x AS DOUBLE) AS value FROM (SELECT proposal_id, list_filter(list_transform(regexp_extract_all(t, '\\b\\d+[\\d\\.,]*%?\\b'), lambda n: try_cast(CASE WHEN contains(n, ',') THEN replace(replace(n, '.', ''), ',', '.') WHEN length(n) - length(replace(n, '.', '')) > 1 THEN replace(n, '.', '') ELSE n END AS DOUBLE)), lambda v: v >= 5 AND v <= 100)[1] AS x FROM (SELECT proposal_id, coalesce(proposal_text, '') AS t FROM {P}))")
def plausible_number(spark, d):
    """The first number of a statement between 5 and 100."""
    p = spread(statements(spark, d).select("proposal_id", F.coalesce("proposal_text", F.lit("")).alias("t")))
    return p.select("proposal_id", R.first_plausible(F.lit(None).cast("string"), F.col("t"), F.lit(5.0), F.lit(100.0)).alias("value"))


@query(f"SELECT party, y AS year, round(avg(b + (t - b) * (y - 2026) / 5), 6) AS milestone_mean FROM (SELECT party, coalesce(axis_confidence, 0) AS b, concreteness_score AS t FROM {P} WHERE party IS NOT NULL), (VALUES (2027), (2029), (2031)) v(y) GROUP BY party, y")
def milestone_means(spark, d):
    """Means of the values on the line from a first to a last value, at three years, per party."""
    p = statements(spark, d).where("party IS NOT NULL").select("party", F.coalesce("axis_confidence", F.lit(0.0)).alias("b"), F.col("concreteness_score").alias("t"))
    years = [2027, 2029, 2031]
    wide = p.groupBy("party").agg(*(F.round(F.avg(R.milestone(F.lit(2026), F.col("b"), F.col("t"), y)), 6).alias(str(y)) for y in years))
    return wide.unpivot(["party"], [str(y) for y in years], "year", "milestone_mean").withColumn("year", F.col("year").cast("int"))
