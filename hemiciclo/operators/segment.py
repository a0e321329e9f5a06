"""From pages to documents, sections and candidate statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import text as T


def clean_pages(pages: DataFrame, doc: str = "doc", page: str = "page_no", text: str = "text") -> DataFrame:
    """doc and its text: pages without repeated first and last lines and page numbers, in order.

    A first or last line that stands on enough pages (2 of up to 4, else half, 3 at least) goes
    wherever it stands. A word broken over a page end is joined. Null pages are left out.
    """
    base = pages.select(F.col(doc).alias("d"), F.col(page).alias("p"), T.normalized(F.col(text)).alias("t")).where("t IS NOT NULL")
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    edges = base.select("d", "p", F.explode(F.array_distinct(F.array(F.get(lines, F.lit(0)), F.when(F.size(lines) > 0, F.element_at(lines, -1))))).alias("line")).where(F.col("line").isNotNull() & ~T.is_page_number(F.col("line")))
    counts = base.groupBy("d").agg(F.count("*").alias("pages"))
    repeated = edges.groupBy("d", "line").agg(F.count_distinct("p").alias("n")).join(counts, "d")
    least = F.when(F.col("pages") <= 4, 2).otherwise(F.greatest(F.lit(3), F.floor(F.col("pages") / 2)))
    # at most two lines of a page repeat, so a document's list is bounded by its own pages
    marks = repeated.where(F.col("n") >= least).groupBy("d").agg(F.collect_set("line").alias("marks"))
    kept = F.filter(F.split("t", "\n"), lambda x: ~T.is_page_number(x) & ~F.coalesce(F.array_contains(F.col("marks"), x), F.lit(False)))
    body = base.join(marks, "d", "left").select("d", "p", T.dehyphenated(F.array_join(kept, "\n")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: F.trim(x["t"]))
    whole = F.aggregate(F.filter("ts", lambda x: x != ""), F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-") & x.rlike(r"^\p{Ll}"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), x)).otherwise(F.concat(a, F.lit("\n\n"), x)))
    return body.groupBy("d").agg(ordered.alias("ts")).select(F.col("d").alias(doc), whole.alias(text))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_id, section_guess and section_text: cut at heading lines, without a shuffle.

    The part before the first heading is section 1, INTRODUCCION; empty sections are dropped.
    """
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: T.squished(x) != "")
    at = docs.select(key, F.transform(lines, T.squished).alias("ls")).where("ls IS NOT NULL")
    at = at.withColumn("heads", F.filter(F.transform("ls", lambda x, i: F.when(T.is_heading(x), i + 1).otherwise(0)), lambda i: i > 0))
    starts = F.concat(F.array(F.lit(0)), F.col("heads"))
    ends = F.concat(F.col("heads"), F.array(F.size("ls") + 1))
    parts = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("z")),
        lambda x, i: F.struct((i + 1).alias("section_id"), F.when(x["a"] == 0, "INTRODUCCION").otherwise(F.substring(F.get(F.col("ls"), x["a"] - 1), 1, 100)).alias("section_guess"), F.array_join(F.slice(F.col("ls"), x["a"] + 1, x["z"] - x["a"] - 1), "\n").alias("section_text")),
    )
    return at.select(key, F.explode(parts).alias("s")).select(key, "s.*").where("section_text <> ''")


def candidates(parts: DataFrame, key: str, text: str = "section_text") -> DataFrame:
    """key columns of parts with pos and candidate: bullets, then sentences with an action verb; 35 to 800 characters, each once."""
    bullets = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(T.BULLET)), lambda x: T.squished(F.regexp_replace(x, T.BULLET, "")))
    said = F.filter(F.transform(T.sentences(F.col(text)), T.squished), lambda x: F.lower(x).rlike(r"(^|[^\p{L}])(" + "|".join(lex.ACTIONS) + ")"))
    both = F.filter(F.array_distinct(F.concat(bullets, said)), lambda x: F.length(x).between(35, 800))
    return parts.select(*([key] if isinstance(key, str) else key), F.posexplode(both).alias("pos", "candidate"))


def statements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Statements of documents: statement_id, key, section_id, section_guess, statement, tokens_n.

    Ids number a document's candidates before those of under 6 words and repeats are dropped,
    so they may have gaps; of equal statements of a document the first stays.
    """
    found = candidates(sections(docs, key, text), [key, "section_id", "section_guess"])
    order = Window.partitionBy(key).orderBy("section_id", "pos")
    numbered = found.withColumn("n", F.row_number().over(order)).withColumn("tokens_n", T.token_count(F.col("candidate"))).where("tokens_n >= 6")
    first = numbered.withColumn("copy", F.row_number().over(Window.partitionBy(key, "candidate").orderBy("n"))).where("copy = 1")
    return first.select(F.concat(F.lit("doc_"), F.col(key), F.lit("_p"), F.lpad("n", F.greatest(F.lit(4), F.length(F.col("n").cast("string"))), "0")).alias("statement_id"), key, "section_id", "section_guess", F.col("candidate").alias("statement"), "tokens_n")
