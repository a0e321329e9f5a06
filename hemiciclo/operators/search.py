"""Ranked lexical search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions import text as T
from hemiciclo.functions.rules import bound


def fold_query(query: str) -> str:
    import re

    plain = query.lower().translate(str.maketrans(T.MARKED, T.PLAIN))
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def scored(df: DataFrame, corpus: str, query: str, score: str, quant: str, horizon: str, distinct: bool = True) -> DataFrame:
    """df with search_score: 8 for the whole query, 2.2 for each of its words in corpus (folded), and what the row itself is worth."""
    q = fold_query(query)
    words = [w for w in (dict.fromkeys(q.split()) if distinct else q.split()) if len(w) >= 2]
    flag = lambda c, n: F.when(F.col(c), n).otherwise(0.0)
    own = lambda part, bonus: F.col(score) / part + flag(quant, bonus) + flag(horizon, bonus)
    if not q:
        return df.withColumn("search_score", F.round(own(20, 0.5), 6))

    def points(c: Column) -> Column:
        value = F.when(F.contains(c, F.lit(q)), 8.0).otherwise(0.0)
        for w in words:
            value = value + F.when(F.contains(c, F.lit(w)), 2.2).otherwise(0.0)
        return value

    # the corpus may be an expression: it is bound, so that it is folded once and not for each word
    return df.withColumn("search_score", F.round(bound(F.col(corpus), points) + own(30, 0.8), 6))


def top(df: DataFrame, key: str, query: str, corpus: str, score: str, quant: str, horizon: str, n: int = 8) -> DataFrame:
    """The n best rows, without their corpus; ties by score, flags, then the key. Rows that came twice count once."""
    found = scored(df, corpus, query, score, quant, horizon).drop(corpus).distinct().where(F.col("search_score") > 0)
    return found.orderBy(F.desc("search_score"), F.desc_nulls_last(score), F.desc_nulls_last(quant), F.desc_nulls_last(horizon), key).limit(n)


def page(df: DataFrame, key: str, query: str, corpus: str, score: str, quant: str, horizon: str, number: int = 1, size: int = 24, least: float = 1.7, where: dict[str, str] | None = None) -> DataFrame:
    """One page of the rows above `least`, words counted as often as asked, filtered by equal columns.

    Pages before it are cut off by the order itself, so number times size rows are kept, not all.
    """
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == value)
    found = scored(df, corpus, query, score, quant, horizon, distinct=False).drop(corpus).distinct().where(F.col("search_score") > least)
    return found.orderBy(F.desc("search_score"), F.desc_nulls_last(score), key).offset((number - 1) * size).limit(size)


def answer(hits: DataFrame, party: str, axis: str, parties: int = 3, axes: int = 2) -> DataFrame:
    """kind, name and hits_n: the parties and axes that most hits of a bounded list have."""
    top_of = lambda c, n: hits.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("hits_n")).orderBy(F.desc("hits_n"), "name").limit(n).select(F.lit(c).alias("kind"), "name", "hits_n")
    return top_of(party, parties).unionByName(top_of(axis, axes))
