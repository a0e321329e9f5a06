"""Queries of copies, vectors, search, metrics and report views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import rules as R
from hemiciclo.functions import text as T
from hemiciclo.operators import copies, groups, models, search, vectors
from hemiciclo.plans.registry import Registry
from hemiciclo.plans.rules import quoted, sql_fold
from hemiciclo.session import spread, table

registry = Registry()
query = registry.query

SUPERVISED = "(SELECT DISTINCT * FROM propuestas_supervised)"


def supervised(spark, d, *columns):
    df = table(spark, d, "propuestas_supervised").distinct()
    return df.select(*columns) if columns else df


# --- copies
FORM = f"trim(regexp_replace(regexp_replace(regexp_replace({sql_fold('text')}, {quoted(lex.BOILERPLATE)}, ' ', 'g'), '\\b(on|oe) ?[0-9]+\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, source, {FORM} AS form FROM documents), c AS (SELECT form, min(doc_id) AS class_key, count(DISTINCT source) AS parties FROM f WHERE length(form) >= 80 GROUP BY form HAVING count(DISTINCT source) > 1)
    SELECT doc_id, source, class_key, parties FROM f JOIN c USING (form)""")
def exact_duplicates(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", T.without_boilerplate(F.col("text"), lex.BOILERPLATE).alias("form"))
    return copies.exact_classes(docs, "doc_id", "source", "form")


STOPS = sorted({*lex.STOPWORDS, *lex.PLAN_WORDS})


@query(f"""WITH f AS (SELECT min(proposal_id) AS k, list_sort(list_distinct(list_filter(string_split({sql_fold('proposal_text')}, ' '), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(quoted(w) for w in STOPS)}], w)))) AS t FROM propuestas GROUP BY t HAVING len(t) > 0)
    SELECT a.k AS statement_a, b.k AS statement_b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM f a JOIN f b ON a.k < b.k AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t) WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.8""")
def token_similarity(spark, d):
    """Pairs of classes of equal token sets (named by their smallest statement) with a Jaccard similarity of 0.8 or more."""
    hashed = table(spark, d, "propuestas").select("proposal_id", F.array_sort(F.transform(T.token_set(F.col("proposal_text"), STOPS), lambda w: F.xxhash64(w))).alias("t")).where(F.size("t") > 0)
    sets = hashed.groupBy(F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2")).agg(F.min("proposal_id").alias("statement"), F.any_value("t").alias("t"))
    return copies.similar_sets(sets, "statement", "t").select("statement_a", "statement_b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH f AS (SELECT proposal_id, list_sort(list_distinct(list_filter(string_split({sql_fold('proposal_text')}, ' '), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(quoted(w) for w in STOPS)}], w)))) AS t FROM (SELECT DISTINCT proposal_id, proposal_text FROM propuestas WHERE proposal_id IS NOT NULL AND proposal_text IS NOT NULL))
    SELECT proposal_id, min(proposal_id) OVER (PARTITION BY t) AS class_key, count(*) OVER (PARTITION BY t) AS members_n FROM f WHERE len(t) > 0""")
def token_classes(spark, d):
    """Which class of equal token sets a statement belongs to: with token_similarity, all links between different sets."""
    p = spread(table(spark, d, "propuestas").where("proposal_id IS NOT NULL AND proposal_text IS NOT NULL").select("proposal_id", "proposal_text").distinct())
    return copies.set_classes(p.select("proposal_id", T.token_set(F.col("proposal_text"), STOPS).alias("t")), "proposal_id", "t")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT proposal_id, proposal_text AS t FROM propuestas WHERE length(proposal_text) >= 40), c AS (SELECT t, min(proposal_id) AS head FROM p GROUP BY t HAVING count(*) > 1), e AS (SELECT proposal_id AS u, head AS v FROM p JOIN c USING (t) UNION SELECT head, proposal_id FROM p JOIN c USING (t)),
    r AS (SELECT u AS node, u AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u) SELECT node, min(reached) AS component FROM r GROUP BY node""")
def duplicate_components(spark, d):
    """Clusters of statements joined by equal texts: each is linked to its class's smallest id only."""
    p = table(spark, d, "propuestas").where(F.length("proposal_text") >= 40).select("proposal_id", "proposal_text").distinct()
    classes = p.groupBy("proposal_text").agg(F.min("proposal_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return copies.connected(p.join(classes, "proposal_text").select("proposal_id", "head"), "proposal_id", "head")


# --- vectors
VECS = "WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT label, max(n) AS n, list(x ORDER BY pos) AS centroid FROM m GROUP BY label)"


@query(VECS + " SELECT label, n, round(centroid[1], 6) AS first_dim, round(sqrt(list_inner_product(centroid, centroid)), 6) AS norm FROM c")
def vector_centroids(spark, d):
    c = vectors.centroids(table(spark, d, "embeddings"), ["label"], "embedding", least=3)
    return c.select("label", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("first_dim"), F.round(F.sqrt(vectors.dot(F.col("centroid"), F.col("centroid"))), 6).alias("norm"))


@query(VECS + " SELECT a.label AS group_i, b.label AS group_j, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS similarity FROM c a, c b")
def vector_group_similarity(spark, d):
    return vectors.group_similarity(vectors.centroids(table(spark, d, "embeddings"), ["label"], "embedding"), "label")


NETWORK = """WITH e AS (SELECT proposal_id, min(embedding) AS embedding FROM proposal_vectors WHERE embedding IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT proposal_id, party, axis FROM propuestas WHERE party IS NOT NULL), v AS (SELECT axis, party, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM e JOIN p USING (proposal_id)),
    m AS (SELECT axis, party, pos, avg(x) AS x, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT axis, party, max(n) AS n, list(x ORDER BY pos) AS centroid FROM m GROUP BY axis, party HAVING max(n) >= 3), edges AS (SELECT a.axis, a.party AS group_i, b.party AS group_j, list_cosine_similarity(a.centroid, b.centroid) AS s FROM c a JOIN c b ON a.axis = b.axis AND a.party < b.party)"""


def axis_centroids(spark, d):
    e = table(spark, d, "proposal_vectors").where("embedding IS NOT NULL").groupBy("proposal_id").agg(F.min("embedding").alias("embedding"))
    p = table(spark, d, "propuestas").where("party IS NOT NULL").select("proposal_id", "party", "axis").distinct()
    return vectors.centroids(e.join(p, "proposal_id"), ["axis", "party"], "embedding", least=3)


@query(NETWORK + " SELECT axis, group_i, group_j, round(s, 6) AS similarity, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.82 THEN 'medium' ELSE 'low' END AS band FROM edges WHERE s >= 0.72")
def axis_network_edges(spark, d):
    e = vectors.group_similarity(axis_centroids(spark, d), "party", "axis", 0.72)
    return e.withColumn("band", F.when(F.col("similarity") >= 0.9, "high").when(F.col("similarity") >= 0.82, "medium").otherwise("low"))


@query(NETWORK + ", k AS (SELECT * FROM edges WHERE s >= 0.72), ends AS (SELECT axis, group_i AS party FROM k UNION SELECT axis, group_j FROM k) SELECT axis, count(*) AS edges_n, (SELECT count(*) FROM ends WHERE ends.axis = k.axis) AS parties_n, round(avg(s), 6) AS avg_similarity, round(max(s), 6) AS max_similarity FROM k GROUP BY axis")
def axis_network_summary(spark, d):
    e = vectors.group_similarity(axis_centroids(spark, d), "party", "axis", 0.72)
    ends = e.select("axis", F.explode(F.array("group_i", "group_j")).alias("party")).groupBy("axis").agg(F.count_distinct("party").alias("parties_n"))
    return e.groupBy("axis").agg(F.count("*").alias("edges_n"), F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.round(F.max("similarity"), 6).alias("max_similarity")).join(ends, "axis")


@query(NETWORK + " SELECT axis, party, n AS statements_n, greatest(8, CAST(round_even(3 * sqrt(n), 0) AS INT)) AS node_size FROM c")
def axis_network_nodes(spark, d):
    return axis_centroids(spark, d).select("axis", "party", F.col("n").alias("statements_n"), F.greatest(F.lit(8), F.bround(3 * F.sqrt("n"), 0).cast("int")).alias("node_size"))


# --- search
CORPUS = f"SELECT *, {sql_fold('concat_ws(chr(32), party, axis, proposal_text, source_snippet, instrument_type)')} AS corpus FROM (SELECT DISTINCT * FROM propuestas)"


def sql_score(q: str) -> str:
    folded = search.fold_query(q)
    words = [w for w in dict.fromkeys(folded.split()) if len(w) >= 2]
    return f"round(CASE WHEN contains(corpus, {quoted(folded)}) THEN 8.0 ELSE 0 END + " + " + ".join(f"CASE WHEN contains(corpus, {quoted(w)}) THEN 2.2 ELSE 0 END" for w in words) + " + concreteness_score / 30 + CASE WHEN has_quant_target THEN 0.8 ELSE 0 END + CASE WHEN has_time_horizon THEN 0.8 ELSE 0 END, 6)"


QUESTION = "Agua potable en la zona rural"


def corpus(spark, d):
    # rows that came twice are taken once behind the score, when no text is left to shuffle
    p = spread(table(spark, d, "propuestas").select("proposal_id", "party", "axis", "proposal_text", "source_snippet", "instrument_type", "concreteness_score", "has_quant_target", "has_time_horizon"))
    folded = p.withColumn("corpus", T.folded(F.concat_ws(" ", "party", "axis", "proposal_text", "source_snippet", "instrument_type")))
    return folded.drop("proposal_text", "source_snippet", "instrument_type")


@query(f"SELECT proposal_id, search_score FROM (SELECT *, {sql_score(QUESTION)} AS search_score FROM ({CORPUS})) ORDER BY search_score DESC, concreteness_score DESC NULLS LAST, has_quant_target DESC, has_time_horizon DESC, proposal_id LIMIT 8")
def search_topk(spark, d):
    return search.top(corpus(spark, d), "proposal_id", QUESTION, "corpus", "concreteness_score", "has_quant_target", "has_time_horizon").select("proposal_id", "search_score")


@query(f"SELECT proposal_id, {sql_score(QUESTION)} AS search_score FROM ({CORPUS})")
def search_scores(spark, d):
    return search.scored(corpus(spark, d), "corpus", QUESTION, "concreteness_score", "has_quant_target", "has_time_horizon").drop("corpus").distinct().select("proposal_id", "search_score")


@query(f"WITH h AS (SELECT party, axis, row_number() OVER (ORDER BY search_score DESC, concreteness_score DESC NULLS LAST, has_quant_target DESC, has_time_horizon DESC, proposal_id) AS n FROM (SELECT *, {sql_score(QUESTION)} AS search_score FROM ({CORPUS}))) SELECT party, axis, count(*) AS hits_n FROM h WHERE n <= 50 GROUP BY party, axis")
def search_summary(spark, d):
    found = search.top(corpus(spark, d), "proposal_id", QUESTION, "corpus", "concreteness_score", "has_quant_target", "has_time_horizon", 50)
    return found.groupBy("party", "axis").agg(F.count("*").alias("hits_n"))


# --- predictions against labels
@query(f"WITH c AS (SELECT axis AS truth, axis_supervised AS pred, count(*) AS n FROM {SUPERVISED} WHERE axis IS NOT NULL AND axis_supervised IS NOT NULL GROUP BY ALL), k AS (SELECT truth AS c FROM c UNION SELECT pred FROM c) SELECT a.c AS truth, b.c AS pred, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.truth = a.c AND c.pred = b.c")
def confusion_matrix(spark, d):
    return groups.confusion(supervised(spark, d), "axis", "axis_supervised")


@query(f"""WITH c AS (SELECT axis AS truth, axis_supervised AS pred, count(*) AS n FROM {SUPERVISED} WHERE axis IS NOT NULL AND axis_supervised IS NOT NULL GROUP BY ALL), k AS (SELECT truth AS c FROM c UNION SELECT pred FROM c),
    s AS (SELECT c, coalesce((SELECT sum(n) FROM c WHERE truth = k.c), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE pred = k.c), 0) AS predicted, coalesce((SELECT sum(n) FROM c WHERE truth = k.c AND pred = k.c), 0) AS hit FROM k), m AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s)
    SELECT c AS "class", CAST(support AS BIGINT) AS support, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def class_metrics(spark, d):
    return groups.class_metrics(groups.confusion(supervised(spark, d), "axis", "axis_supervised"))


@query(f"SELECT instrument_type, count(*) AS n, round(sqrt(avg((axis_supervised_prob - instrument_supervised_prob) ** 2)), 6) AS rmse, round(avg(abs(axis_supervised_prob - instrument_supervised_prob)), 6) AS mae FROM {SUPERVISED} WHERE axis_supervised_prob IS NOT NULL AND instrument_supervised_prob IS NOT NULL GROUP BY 1")
def regression_errors(spark, d):
    gap = F.col("axis_supervised_prob") - F.col("instrument_supervised_prob")
    return supervised(spark, d).where(gap.isNotNull()).groupBy("instrument_type").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(F.abs(gap)), 6).alias("mae"))


# --- report views
P = "(SELECT DISTINCT * FROM propuestas)"


def statements(spark, d):
    return table(spark, d, "propuestas").distinct()


@query(f"SELECT party, count(*) AS statements_n, round(avg(concreteness_score), 6) AS avg_score, count(DISTINCT doc_id) AS plans_n, round(avg(has_quant_target::INT), 6) AS pct_quant, round(avg((mentions_cost OR mentions_funding_source)::INT), 6) AS pct_cost FROM {P} WHERE party IS NOT NULL GROUP BY party")
def view_volume_by_party(spark, d):
    cost = F.col("mentions_cost") | F.col("mentions_funding_source")
    return statements(spark, d).where("party IS NOT NULL").groupBy("party").agg(F.count("*").alias("statements_n"), F.round(F.avg("concreteness_score"), 6).alias("avg_score"), F.count_distinct("doc_id").alias("plans_n"), F.round(F.avg(F.col("has_quant_target").cast("int")), 6).alias("pct_quant"), F.round(F.avg(cost.cast("int")), 6).alias("pct_cost"))


@query(f"WITH n AS (SELECT party, axis, count(*) AS n FROM {P} WHERE party IS NOT NULL AND axis <> 'otros' GROUP BY ALL), s AS (SELECT party, axis, n / sum(n) OVER (PARTITION BY party) AS share FROM n) SELECT axis, round(avg(share), 6) AS mean_share, count(*) AS parties_n FROM s GROUP BY axis")
def view_agenda_shares(spark, d):
    """Mean over the parties of an axis's share of a party; the totals are joined, not windowed."""
    n = statements(spark, d).where("party IS NOT NULL AND axis <> 'otros'").groupBy("party", "axis").agg(F.count("*").alias("n"))
    total = n.groupBy("party").agg(F.sum("n").alias("total"))
    return n.join(total, "party").groupBy("axis").agg(F.round(F.avg(F.col("n") / F.col("total")), 6).alias("mean_share"), F.count("*").alias("parties_n"))


@query(f"SELECT axis, component, round(avg(flag::INT), 6) AS share FROM (SELECT axis, unnest(['quant', 'horizon', 'cost', 'funding', 'vague']) AS component, unnest([has_quant_target, has_time_horizon, mentions_cost, mentions_funding_source, vague_flag]) AS flag FROM {P}) GROUP BY ALL")
def view_components(spark, d):
    flags = {"quant": "has_quant_target", "horizon": "has_time_horizon", "cost": "mentions_cost", "funding": "mentions_funding_source", "vague": "vague_flag"}
    wide = statements(spark, d).groupBy("axis").agg(*(F.round(F.avg(F.col(c).cast("int")), 6).alias(n) for n, c in flags.items()))
    return wide.unpivot(["axis"], list(flags), "component", "share")


@query(f"WITH g AS (SELECT party, count(*) AS n, avg(concreteness_score) AS s FROM {P} WHERE party IS NOT NULL GROUP BY party) SELECT round(corr(n, s), 6) AS volume_score_corr, CASE WHEN abs(corr(n, s)) < 0.2 THEN 'weak' WHEN corr(n, s) > 0 THEN 'positive' ELSE 'negative' END AS reading FROM g")
def view_volume_score_correlation(spark, d):
    g = statements(spark, d).where("party IS NOT NULL").groupBy("party").agg(F.count("*").alias("n"), F.avg("concreteness_score").alias("s"))
    r = F.col("r")
    return g.agg(F.corr("n", "s").alias("r")).select(F.round(r, 6).alias("volume_score_corr"), F.when(F.abs(r) < 0.2, "weak").when(r > 0, "positive").otherwise("negative").alias("reading"))


@query(f"""SELECT 'statements' AS metric, count(*)::VARCHAR AS value FROM {P} UNION ALL SELECT 'parties', count(DISTINCT party)::VARCHAR FROM {P} UNION ALL SELECT 'with_id_and_snippet', (count(*) FILTER (WHERE proposal_id IS NOT NULL AND trim(coalesce(source_snippet, '')) <> ''))::VARCHAR FROM {P}
    UNION ALL SELECT 'with_numbers', (count(*) FILTER (WHERE numbers_found IS NOT NULL))::VARCHAR FROM {P}""")
def verification_summary(spark, d):
    m = statements(spark, d).agg(F.count("*").alias("statements"), F.count_distinct("party").alias("parties"), F.count_if(F.col("proposal_id").isNotNull() & (F.trim(F.coalesce("source_snippet", F.lit(""))) != "")).alias("with_id_and_snippet"), F.count_if(F.col("numbers_found").isNotNull()).alias("with_numbers"))
    return m.select(*(F.col(c).cast("string").alias(c) for c in m.columns)).unpivot([], m.columns, "metric", "value")


INDICATORS = [("agua", "ambiente", "agua|saneamiento|cuenca"), ("aulas", "educacion", "aula|escuela|beca"), ("camas", "salud", "cama|hospital|posta"), ("empleo", "empleo", "empleo|trabajo"), ("vias", "infraestructura", "via|puente|camino")]


@query("WITH r(indicator, raxis, pattern) AS (VALUES " + ", ".join(f"({quoted(i)}, {quoted(a)}, {quoted(p)})" for i, a, p in INDICATORS) + f"""), p AS (SELECT proposal_id, axis, {sql_fold("coalesce(proposal_text, '')")} AS t FROM {P}), m AS (SELECT proposal_id, indicator, len(regexp_extract_all(t, pattern)) AS hits_n, len(regexp_extract_all(t, pattern)) + CASE WHEN axis = raxis THEN 0.5 ELSE 0 END AS s FROM p, r),
    o AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY s DESC, indicator) AS n FROM m) SELECT proposal_id, indicator, CAST(hits_n AS INT) AS hits_n, CASE WHEN s >= 3 THEN 'alta' WHEN s >= 1 THEN 'media' ELSE 'baja' END AS map_quality FROM o WHERE n = 1""")
def indicator_map_top1(spark, d):
    """Each statement's best indicator of a small fixed list; the best is taken within the row, without a join or shuffle."""
    t = T.folded(F.coalesce(F.col("proposal_text"), F.lit("")))
    p = statements(spark, d).select("proposal_id", "axis", t.alias("t"))
    scored = F.array(*(F.struct((-(F.regexp_count("t", F.lit(pattern)) + F.when(F.col("axis") == axis, 0.5).otherwise(0.0))).alias("far"), F.lit(i).alias("indicator"), F.regexp_count("t", F.lit(pattern)).alias("hits_n")) for i, axis, pattern in INDICATORS))
    best = p.select("proposal_id", F.array_min(scored).alias("b"))
    return best.select("proposal_id", "b.indicator", "b.hits_n", F.when(-F.col("b.far") >= 3, "alta").when(-F.col("b.far") >= 1, "media").otherwise("baja").alias("map_quality"))


# --- models: checked in tests
FEATURES, CATEGORIES = ["has_quant_target", "has_time_horizon", "mentions_cost", "mentions_funding_source", "vague_flag", "tokens_n", "axis_confidence"], ["axis", "instrument_type"]


def texts(spark, d):
    return statements(spark, d).where("proposal_text IS NOT NULL")


def readiness(spark, d):
    return models.Readiness(statements(spark, d), "proposal_id", "concreteness_score", FEATURES, CATEGORIES, others=["party"])


@query()
def svd_embed(spark, d):
    return models.svd_vectors(texts(spark, d), "proposal_id", "proposal_text")


@query()
def topics(spark, d):
    return models.topics(texts(spark, d), "proposal_id", "proposal_text")


@query()
def topics_kmeans(spark, d):
    """Topics where no topic model can be fitted."""
    return models.topics_by_means(texts(spark, d), "proposal_id", "proposal_text")


@query()
def label_model(spark, d):
    return models.cross_validated(supervised(spark, d).where("proposal_text IS NOT NULL"), "proposal_id", "proposal_text", "instrument_type")


@query()
def label_predictions(spark, d):
    """A class and its probability for every statement, by the model of all labelled ones."""
    gold = supervised(spark, d).where("proposal_text IS NOT NULL").select("proposal_id", "proposal_text", F.col("axis").alias("label"))
    silver = gold.withColumn("label", R.topic(F.col("proposal_text"))["axis"])
    chosen, _ = models.label_source(gold, silver, "label", 60)
    return models.LabelModel(chosen, "proposal_id", "proposal_text", "label").predicted()


@query()
def readiness_model(spark, d):
    return readiness(spark, d).predictions()


@query()
def readiness_residuals(spark, d):
    return models.residuals_by_group(readiness(spark, d).predictions("party"), "party")


@query()
def view_importance_top(spark, d):
    """The 15 features of most gain: a top-k report."""
    return spark.createDataFrame(readiness(spark, d).importances()[:15], "feature string, importance_pct double")


@query()
def partial_dependence(spark, d):
    """Curves with their band and the place of each value on its own curve."""
    curves = readiness(spark, d).dependence()
    return curves.withColumn("x_rank", F.row_number().over(Window.partitionBy("feature").orderBy("value")))  # a few values for each feature
