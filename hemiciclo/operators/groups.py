"""Aggregates by group, coverage reports, opposed stances, metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import rules as R
from hemiciclo.functions import text as T
from hemiciclo.session import checkpointed


def share(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("int")), 6)


def group_scores(df: DataFrame, group: str, axis: str) -> DataFrame:
    """Per group and axis, and per group as axis 'overall': counts, share of the group, mean score, shares of flags."""
    total = Window.partitionBy("g")
    rolled = df.select(F.coalesce(F.col(group), F.lit("(none)")).alias("g"), F.coalesce(F.col(axis), F.lit("otros")).alias("a"), "score", "quant", "horizon", "cost", "funding", F.col("evidence").isNotNull().alias("evidence"))
    rolled = rolled.groupingSets([["g", "a"], ["g"]], "g", "a").agg(
        F.grouping("a").alias("is_total"), F.count("*").alias("statements_n"), F.round(F.avg("score"), 6).alias("avg_score"), share(F.col("quant")).alias("pct_quant"), share(F.col("horizon")).alias("pct_horizon"), share(F.col("cost")).alias("pct_cost"), share(F.col("funding")).alias("pct_funding"), share(F.col("evidence")).alias("pct_evidence")
    )
    size = F.max(F.when(F.col("is_total") == 1, F.col("statements_n"))).over(total)
    return rolled.select(F.col("g").alias(group), F.when(F.col("is_total") == 1, "overall").otherwise(F.col("a")).alias("axis"), "statements_n", F.round(F.col("statements_n") / size, 6).alias("axis_share"), "avg_score", "pct_quant", "pct_horizon", "pct_cost", "pct_funding", "pct_evidence")


def coverage(df: DataFrame, party: str, text: str, pack: dict[str, dict[str, list[str]]] = lex.COVERAGE) -> DataFrame:
    """party, dim, coverage_group, statements_n, covered_n: one pass, all groups at once, then unpivoted."""
    t = T.folded(F.coalesce(F.col(text), F.lit("")))
    flags = {f"{dim}|{g}": keys for dim, groups in pack.items() for g, keys in groups.items()}
    marked = df.select(F.col(party).alias("party"), t.alias("t"))
    counted = marked.groupBy("party").agg(F.count("*").alias("statements_n"), *(F.count_if(R.mentions(F.col("t"), keys)).alias(name) for name, keys in flags.items()))
    long = counted.unpivot(["party", "statements_n"], list(flags), "name", "covered_n")
    return long.select("party", F.split_part("name", F.lit("|"), F.lit(1)).alias("dim"), F.split_part("name", F.lit("|"), F.lit(2)).alias("coverage_group"), "statements_n", "covered_n")


def blindspots(covered: DataFrame, bands: tuple[float, float] = (0.03, 0.08)) -> DataFrame:
    part = F.col("covered_n") / F.col("statements_n")
    return covered.select("party", "dim", "coverage_group", F.round(part, 6).alias("coverage_share"), F.when(part == 0, "sin_cobertura").when(part < bands[0], "muy_baja").when(part < bands[1], "baja").otherwise("cobertura_ok").alias("blindspot_flag"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Per party and dimension the mean of its groups' shares, and how many groups it covers."""
    part = F.col("covered_n") / F.col("statements_n")
    return covered.groupBy("party", "dim").agg(F.max("statements_n").alias("statements_n"), F.count_if(part > 0).alias("groups_covered_n"), F.round(F.avg(part), 6).alias("coverage_avg"), F.round(F.min(part), 6).alias("coverage_min"))


def stance_hits(df: DataFrame, key: str, text: str, pack=lex.STANCES) -> DataFrame:
    """key, dimension and stance of the rules a text matches; a text that matches both stances of a dimension has neither."""
    t = F.lower(F.col(text))
    found = F.array_compact(F.array(*(
        F.when(t.rlike(a) & ~t.rlike(b), F.struct(F.lit(dim).alias("dimension"), F.lit(sa).alias("stance"))).when(t.rlike(b) & ~t.rlike(a), F.struct(F.lit(dim).alias("dimension"), F.lit(sb).alias("stance"))) for dim, sa, sb, a, b in pack
    )))
    return df.select(*df.columns, F.explode(found).alias("hit")).select(*df.columns, "hit.dimension", "hit.stance")


def contradictions(hits: DataFrame, party: str, key: str, signal: str, pack=lex.STANCES, digits: int | None = 4) -> DataFrame:
    """Per party and dimension the strongest statement of either stance, where both exist.

    Only the best of each stance goes into the join, by a partial aggregate, however many hits a party has.
    Ties: the smaller key. Nulls in party or signal count as signal 0 and no party.
    """
    best = hits.where(F.col(party).isNotNull()).groupBy(F.col(party).alias("party"), "dimension", "stance").agg(F.min(F.struct((-F.coalesce(signal, F.lit(0.0))).alias("far"), F.col(key).alias("key"))).alias("b"))
    sides = {stance: (dim, side) for dim, sa, sb, _, _ in pack for stance, side in ((sa, "a"), (sb, "b"))}
    side = F.create_map(*(F.lit(x) for stance, (_, s) in sides.items() for x in (stance, s)))[F.col("stance")]
    sided = best.withColumn("side", side)
    wide = sided.groupBy("party", "dimension").agg(*(F.max(F.when(F.col("side") == s, F.struct("stance", "b"))).alias(s) for s in ("a", "b"))).where("a IS NOT NULL AND b IS NOT NULL AND a.b.key <> b.b.key")
    score = -50 * (F.col("a.b.far") + F.col("b.b.far"))
    return wide.select("party", "dimension", F.col("a.stance").alias("stance_a"), F.col("a.b.key").alias("key_a"), F.col("b.stance").alias("stance_b"), F.col("b.b.key").alias("key_b"), (score if digits is None else F.round(score, digits)).alias("contradiction_score"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, pred, n for every pair of classes that occur, 0 included."""
    cells = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))
    # as many rows as there are classes squared
    classes = cells.select("truth").union(cells.select("pred")).distinct().withColumnRenamed("truth", "c")
    grid = classes.select(F.col("c").alias("truth")).join(classes.select(F.col("c").alias("pred")), F.lit(True))
    return grid.join(cells, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Per class support, precision, recall and F1; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sides = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    sums = sides.groupBy("c").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return sums.select(F.col("c").alias("class"), "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def overall_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """classes_n, rows_n, accuracy, macro and support-weighted F1 over all labelled rows; 0 where a denominator is 0. No grid of classes is made."""
    cells = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("s"), zero.alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("h")), F.struct(F.col("p").alias("c"), zero.alias("s"), F.col("n").alias("p"), zero.alias("h")))).alias("x")).select("x.*")
    f = sides.groupBy("c").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("h").alias("h")).withColumn("f1", F.when(F.col("s") + F.col("p") > 0, 2 * F.col("h") / (F.col("s") + F.col("p"))).otherwise(0.0))
    guarded = lambda top: F.round(F.when(F.sum("s") > 0, F.sum(top) / F.sum("s")).otherwise(0.0), 6)
    return f.agg(F.count("*").alias("classes_n"), F.sum("s").alias("rows_n"), guarded(F.col("h")).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), guarded(F.col("f1") * F.col("s")).alias("weighted_f1"))


def term_weights(df: DataFrame, key: str, text: str, stopwords: list[str]) -> DataFrame:
    """key, term, n, tf and tf_idf with idf = ln(N / df). Counts are over all texts with a term; no term is left out."""
    words = df.select(key, F.filter(T.words(F.col(text)), lambda w: ~w.isin(stopwords)).alias("ws"))
    # one row for each text and term, as in the result: read, split and counted once
    terms = checkpointed(words.select(key, F.size("ws").alias("size"), F.explode("ws").alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"), F.max("size").alias("size")))
    docs = terms.select(F.count_distinct(key).alias("docs"))  # one row
    used = terms.groupBy("term").agg(F.count("*").alias("used"))
    joined = terms.join(used, "term").join(F.broadcast(docs), F.lit(True))
    tf = F.col("n") / F.col("size")
    return joined.select(key, "term", "n", tf.alias("tf"), (tf * F.log(F.col("docs") / F.col("used"))).alias("tf_idf"))


def tfidf(df: DataFrame, key: str, text: str, stopwords: list[str]) -> DataFrame:
    """term_weights() with rounded weights."""
    return term_weights(df, key, text, stopwords).withColumns({"tf": F.round("tf", 6), "tf_idf": F.round("tf_idf", 6)})
