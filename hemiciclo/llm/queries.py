"""The queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.llm.canonical import canonical
from hemiciclo.llm.encoding import encode_corpus
from hemiciclo.llm.forest import nearest
from hemiciclo.llm.leaks import longest_leaks
from hemiciclo.llm.pages import noise, repaired_fields
from hemiciclo.llm.residue import residue_scores, with_residue
from hemiciclo.llm.sameness import look_alike_classes, look_alikes, with_one_form
from hemiciclo.llm.spans import shared_spans
from hemiciclo.llm.tables import one_per_key, whole
from hemiciclo.llm.topn import top_n


def statements(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return one_per_key(whole(spark, sf_dir, name, "proposal_id", *columns), "proposal_id", *columns)


FIELDS = ["proposal_text", "source_snippet"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(statements(spark, sf_dir, "propuestas", "doc_id", *FIELDS), "proposal_id", "doc_id", FIELDS, ["source_snippet"])


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields as continuous paragraphs."""
    return repaired_fields(statements(spark, sf_dir, "propuestas", "doc_id", *FIELDS), "proposal_id", "doc_id", FIELDS, ["source_snippet"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(statements(spark, sf_dir, "propuestas_supervised", "doc_id", "proposal_text"), "proposal_id", "doc_id", "proposal_text")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each statement how many of its characters stand elsewhere; 0 for the others."""
    rows = statements(spark, sf_dir, "propuestas_supervised", "doc_id", "proposal_text")
    spans = shared_spans(rows, "proposal_id", "doc_id", "proposal_text").groupBy("proposal_id").agg(F.sum(F.expr("span_end - span_start + 1")).alias("shared"))
    length = F.coalesce(F.length("proposal_text"), F.lit(0))
    return rows.join(spans, "proposal_id", "left").select("proposal_id", F.coalesce("shared", F.lit(0)).alias("shared_chars"), F.when(length > 0, F.round(F.coalesce("shared", F.lit(0)) / length, 6)).otherwise(0.0).alias("shared_part"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["party", "dimension", "stance"]
    return top_n(whole(spark, sf_dir, "hits", *keys, "proposal_id", "signal"), keys, "proposal_id", "signal", 3).select(*keys, "proposal_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(statements(spark, sf_dir, "propuestas_supervised", "party"), "proposal_id", "party", whole(spark, sf_dir, "party_reference", "party_id", "party_name", "party_code"), "party_id", "party_name", "party_code")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that mean no listed party, with the statements that have them."""
    rows = statements(spark, sf_dir, "propuestas_supervised", "party")
    return p4_found(spark, sf_dir).where("party_id = -1").join(rows, "proposal_id").groupBy(F.col("party").alias("typed")).agg(F.count("*").alias("statements_n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = one_per_key(whole(spark, sf_dir, "proposal_vectors", "proposal_id", "embedding").where("embedding IS NOT NULL"), "proposal_id", "embedding")
    pairs = nearest(vectors, "proposal_id", "embedding", k=5, least_cosine=0.90)
    return pairs.select(F.least("proposal_id", "neighbour").alias("proposal_id_a"), F.greatest("proposal_id", "neighbour").alias("proposal_id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes(statements(spark, sf_dir, "propuestas", "proposal_text"), "proposal_id", "proposal_text")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement with the class of all that look like it, and how many of them are stored differently."""
    return look_alike_classes(statements(spark, sf_dir, "propuestas", "proposal_text"), "proposal_id", "proposal_text")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement's text in the one form of all that look like it."""
    return with_one_form(statements(spark, sf_dir, "propuestas", "proposal_text"), "proposal_id", "proposal_text").select("proposal_id", "form")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(whole(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of each document and item that it contains, with its places."""
    return longest_leaks(whole(spark, sf_dir, "documents", "doc_id", "text"), whole(spark, sf_dir, "eval_items", "item_id", "text"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_longest(spark, sf_dir).select("doc_id", "item_id")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain when those with a leak are removed."""
    return whole(spark, sf_dir, "documents", "doc_id").join(p8_found(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_residue(whole(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the likelihood ratio of its worst window, and how much of it is residue."""
    scored = residue_scores(whole(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return scored.select("doc_id", F.round("score", 3).alias("score"), F.round("coverage", 6).alias("coverage"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_shares, p3_found, p4_found, p4_unmatched, p5_found, p6_found, p6_classes, p6_forms, p7_ids, p8_found, p8_longest, p8_kept, p9_found, p9_scores)}


SPANS = """WITH p AS (SELECT DISTINCT proposal_id, doc_id, proposal_text AS t FROM propuestas_supervised WHERE proposal_text IS NOT NULL AND doc_id IS NOT NULL),
    w AS (SELECT proposal_id, doc_id, s, substr(t, s, 160) AS x FROM (SELECT *, unnest(range(1, length(t) - 158)) AS s FROM p)),
    k AS (SELECT x FROM w GROUP BY x HAVING count(DISTINCT doc_id) > 1), h AS (SELECT proposal_id, s FROM w SEMI JOIN k USING (x)),
    g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY proposal_id ORDER BY s) <= 160 THEN 0 ELSE 1 END AS fresh FROM h), r AS (SELECT *, sum(fresh) OVER (PARTITION BY proposal_id ORDER BY s) AS run FROM g),
    spans AS (SELECT proposal_id, min(s) AS span_start, max(s) + 159 AS span_end FROM r GROUP BY proposal_id, run)"""
LEAKS = """WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS l FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 19], ' ') AS g FROM (SELECT *, unnest(range(1, len(l) - 18)) AS i FROM d)), eg AS (SELECT DISTINCT item_id, array_to_string(l[i:i + 19], ' ') AS g FROM (SELECT *, unnest(range(1, len(l) - 18)) AS i FROM e)),
    found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))"""

LEAKS_LONGEST = """WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS l FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, i, array_to_string(l[i:i + 19], ' ') AS g FROM (SELECT *, unnest(range(1, len(l) - 18)) AS i FROM d)), eg AS (SELECT item_id, j, array_to_string(l[j:j + 19], ' ') AS g FROM (SELECT *, unnest(range(1, len(l) - 18)) AS j FROM e)),
    m AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dg JOIN eg USING (g)),
    r AS (SELECT doc_id, item_id, count(*) + 19 AS n, min(i) AS i, min(j) AS j FROM m GROUP BY doc_id, item_id, i - j, run)
    SELECT doc_id, item_id, n AS words_n, i AS doc_word, j AS item_word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, i, j) AS k FROM r) WHERE k = 1"""


def oracle_sql():
    return {
        "p2_found": SPANS + " SELECT proposal_id, span_start, span_end FROM spans",
        "p2_shares": SPANS + """, n AS (SELECT proposal_id, sum(span_end - span_start + 1) AS shared FROM spans GROUP BY proposal_id), a AS (SELECT DISTINCT proposal_id, proposal_text AS t FROM propuestas_supervised WHERE proposal_id IS NOT NULL)
            SELECT proposal_id, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN length(t) > 0 THEN round(coalesce(shared, 0) / length(t), 6) ELSE 0.0 END AS shared_part FROM a LEFT JOIN n USING (proposal_id)""",
        "p3_found": """
            SELECT party, dimension, stance, proposal_id FROM (
                SELECT *, row_number() OVER (PARTITION BY party, dimension, stance ORDER BY signal DESC, proposal_id) AS place
                FROM (SELECT party, dimension, stance, proposal_id, max(signal) AS signal FROM hits
                      WHERE party IS NOT NULL AND dimension IS NOT NULL AND stance IS NOT NULL
                        AND proposal_id IS NOT NULL AND signal IS NOT NULL AND NOT isnan(signal)
                      GROUP BY ALL))
            WHERE place <= 3""",
        "p8_found": LEAKS + " SELECT doc_id, item_id FROM found",
        "p8_longest": LEAKS_LONGEST,
        "p8_kept": LEAKS + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
    }
