"""Vectors in array columns: means of groups, cosines, networks of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def centroids(df: DataFrame, group: list[str], vector: str, least: int = 1) -> DataFrame:
    """group, n and centroid of groups of at least `least` vectors. Means are combined before the shuffle."""
    sizes = df.where(F.col(vector).isNotNull()).select(*group, F.col(vector).cast("array<double>").alias("v"))
    means = sizes.select(*group, F.posexplode("v").alias("pos", "x")).groupBy(*group, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(*group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid")).where(F.col("n") >= least)


def pairs_of_groups(centres: DataFrame, group: str, within: list[str] | None = None, square: bool = False, blocks: int = 8) -> DataFrame:
    """group_i, ci, group_j and cj of all pairs of groups, i < j or the square, within equal columns.

    The rows are groups, not members: all pairs are what is asked for. Groups are dealt into blocks
    and pairs of blocks are joined on both block numbers, so that the pairs are spread over
    blocks * blocks tasks and no side is broadcast unless it is small.
    """
    cols = within or []
    own = F.pmod(F.xxhash64(group), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = centres.select(*cols, F.col(group).alias("group_i"), F.col("centroid").alias("ci"), own.alias("block_i"), every.alias("block_j"))
    b = centres.select(*cols, F.col(group).alias("group_j"), F.col("centroid").alias("cj"), own.alias("block_j"), every.alias("block_i"))
    met = a.join(b, [*cols, "block_i", "block_j"])
    return (met if square else met.where(F.col("group_i") < F.col("group_j"))).select(*cols, "group_i", "ci", "group_j", "cj")


def group_similarity(centres: DataFrame, group: str, within: str | None = None, least: float | None = None, digits: int | None = 6) -> DataFrame:
    """Cosines of all pairs of groups (the square, itself included; with `least` only i < j at or above it).

    `within` keeps pairs to one axis; without digits the cosines aren't rounded.
    """
    cols = [c for c in (within,) if c]
    value = cosine(F.col("ci"), F.col("cj"))
    pairs = pairs_of_groups(centres, group, cols, square=least is None)
    if least is not None:
        pairs = pairs.where(value >= least)
    return pairs.select(*cols, "group_i", "group_j", (value if digits is None else F.round(value, digits)).alias("similarity"))


def strongest(edges: DataFrame, axis: str, n: int) -> DataFrame:
    """The n edges of highest similarity of each axis with their place. Ties: the smaller groups.

    Partial lists are cut to n before they meet, so no axis is gathered whole.
    """
    salt = F.pmod(F.xxhash64("group_i", "group_j"), F.lit(16))
    order = lambda: F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "group_i", "group_j")))
    some = edges.groupBy(axis, salt.alias("salt")).agg(F.slice(order(), 1, n).alias("l"))
    whole = some.select(axis, F.explode("l").alias("e")).groupBy(axis).agg(F.slice(F.array_sort(F.collect_list("e")), 1, n).alias("l"))
    return whole.select(axis, F.posexplode("l").alias("pos", "e")).select(axis, "e.group_i", "e.group_j", (-F.col("e.far")).alias("similarity"), (F.col("pos") + 1).alias("place"))
