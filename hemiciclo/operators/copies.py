"""Equal and similar texts, matching and components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.operators import overlap
from hemiciclo.operators.vectors import cosine
from hemiciclo.session import checkpointed, importable

BETWEEN = "\x1f"  # stands between the words of a set
FILTER_WORDS = 1 << 20  # of 64 bits


def exact_classes(df: DataFrame, key: str, party: str, form: str, least: int = 80) -> DataFrame:
    """key, class_key (smallest key of its class) and parties of texts that several parties share word for word.

    form is the text to compare; it is computed once and travels as two hashes. One row for each
    member; copies aren't paired.
    """
    hashed = df.where(F.length(form) >= least).select(key, party, F.xxhash64(form).alias("f1"), F.xxhash64(F.lit(7), form).alias("f2"))
    rows = checkpointed(hashed)
    classes = rows.groupBy("f1", "f2").agg(F.min(key).alias("class_key"), F.count_distinct(party).alias("parties")).where("parties > 1")
    return rows.join(classes, ["f1", "f2"]).select(key, party, "class_key", "parties")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) of an undirected graph.

    Labels are replaced by the smallest one among neighbours and their labels until none
    changes; each round's labels are checkpointed. Nothing is gathered on the driver but a count.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "u").select("u", F.least("label", "near").alias("stepped"), "label")
        # a label's own label halves long chains
        jumped = stepped.join(labels.select(F.col("u").alias("stepped"), F.col("label").alias("far")), "stepped").select("u", F.least("stepped", "far").alias("new"), "label")
        jumped = checkpointed(jumped)
        if jumped.where("new <> label").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = jumped.select("u", F.col("new").alias("label"))


def one_to_one(pairs: DataFrame, group: list[str], a: str, b: str, score: str) -> DataFrame:
    """Pairs chosen greedily by descending score (ties: smaller a, then b), each a and each b once in its group.

    In rounds: a pair that is the best of both its sides is chosen, and the pairs that share a
    side with it leave. That gives the greedy choice, whose next pair is always of this kind, and
    no group lies in one task. Each round's rest is checkpointed. Pairs with a null take no part.
    """
    names = [*group, a, b, score]
    left = checkpointed(pairs.select(*names).dropna().groupBy(*group, a, b).agg(F.max(score).alias(score)).select(*names))
    order = F.struct((-F.col(score)).alias("far"), F.col(a).alias("a"), F.col(b).alias("b"))
    chosen = left.limit(0)
    while not left.isEmpty():
        ranked = left.withColumn("__order", order)
        best = lambda side, name: ranked.groupBy(*group, side).agg(F.min("__order").alias(name))  # noqa: E731, B023
        now = ranked.join(best(a, "__a"), [*group, a]).join(best(b, "__b"), [*group, b]).where("__order = __a AND __order = __b").select(*names)
        now = checkpointed(now)
        chosen = chosen.unionByName(now)
        left = checkpointed(left.join(now.select(*group, a), [*group, a], "left_anti").join(now.select(*group, b), [*group, b], "left_anti").select(*names))
    return chosen


def exact_links(df: DataFrame, key: str, party: str, form: str, least: int = 80) -> DataFrame:
    """key_a, key_b, party_a and party_b of equal texts of several parties: each party's smallest key, linked to the smallest of all.

    A class of n parties gives n - 1 links, whatever its size; exact_classes() has the members. df is
    read twice: hashes of all texts are moved, keys and parties only of those that several parties may share.
    """
    hashed = df.where((F.length(form) >= least) & F.col(party).isNotNull()).select(F.col(key).alias("k"), F.col(party).alias("p"), F.xxhash64(form).alias("f1"), F.xxhash64(F.lit(7), form).alias("f2"))
    several = hashed.groupBy("f1", "f2").agg(F.min(F.xxhash64("p")).alias("least"), F.max(F.xxhash64("p")).alias("most")).where("least < most")
    own = among(hashed, "f1", several.select("f1")).groupBy("f1", "f2", "p").agg(F.min("k").alias("k"))
    parties = own.groupBy("f1", "f2").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("l")).where(F.size("l") > 1)  # one entry for each party
    linked = parties.select(F.col("l")[0].alias("head"), F.explode(F.slice("l", 2, F.size("l") - 1)).alias("own"))
    return linked.where(F.col("own.k") != F.col("head.k")).select(F.col("head.k").alias("key_a"), F.col("own.k").alias("key_b"), F.col("head.p").alias("party_a"), F.col("own.p").alias("party_b"))


def near_links(df: DataFrame, key: str, party: str, tokens: str, vector: str, least_cosine: float = 0.93, least_tokens: int = 8, jaccard: float = 0.65, close: tuple[float, float] = (0.985, 0.45), vectors: DataFrame | None = None, hot: int = 20_000, prepared: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """key_a, key_b, party_a, party_b, cosine and jaccard of near duplicates of different parties.

    Near is a cosine of least_cosine with a Jaccard similarity of `jaccard`, or the pair of `close`.
    Texts of one party with the same token set are one class, named by their smallest key, whose
    vector counts (of several vectors of a key the smallest). Sets are joined first (exactly, by
    rare tokens), then the cosine decides; only vectors of keys that a bounded filter of the
    pairs left lets pass are moved. They are in df, or in `vectors` by key. Rows with a null, of
    few tokens or with vectors of different lengths give no link.

    df is read four times, and its texts stay where they are: a set is known by a 64-bit hash, the
    tokens that are met travel as hashes, and words are moved only of the sets of pairs within the
    bounds. `prepared` makes the tokens from rows of df; it is given only those that a step needs.
    """
    importable(df.sparkSession)
    least = min(jaccard, close[1])
    vecs = (df if vectors is None else vectors).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).dropna()

    def named(rows):  # k, p, the words w and the name of their set; explode keeps the filter from making w twice
        rows = prepared(rows).select(F.col(key).alias("k"), F.col(party).alias("p"), F.explode(F.array(F.sort_array(F.array_distinct(tokens)))).alias("w")).dropna().where(F.size("w") >= least_tokens)
        return rows.select("k", "p", "w", F.xxhash64(F.concat_ws(BETWEEN, "w")).alias("id"))

    members = checkpointed(named(df).select("k", "p", "id").join(vecs.select("k").distinct(), "k", "left_semi").groupBy("id", "p").agg(F.min("k").alias("k")))
    one_of_each = members.groupBy("id").agg(F.min(F.xxhash64("k")).alias("h"))
    hashed = named(among(df, key, one_of_each, "h")).select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("t"))
    pairs = checkpointed(overlapping(hashed, least, hot))
    same = checkpointed(members.groupBy("id").count().where("count > 1").select("id"))
    own = among(members, "id", pairs.select(F.explode(F.array("x", "y")).alias("id")).unionByName(same))
    sets = named(among(df, key, own.select(F.xxhash64("k").alias("h")), "h")).select("id", F.concat_ws(BETWEEN, "w").alias("t")).groupBy("id").agg(F.min("t").alias("t"))
    side = lambda n: sets.select(F.col("id").alias(n), F.col("t").alias(f"t_{n}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    both = both.select("x", "y", shared_part(F.split("t_x", BETWEEN), F.split("t_y", BETWEEN)).alias("jaccard")).where(F.col("jaccard") >= least)
    both = both.unionByName(same.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("jaccard")))
    of = lambda n: own.select(F.col("id").alias(n), F.struct("k", "p").alias(f"m_{n}"))
    met = both.join(of("x"), "x").join(of("y"), "y").where((F.col("m_x.p") != F.col("m_y.p")) & (F.col("m_x.k") != F.col("m_y.k")) & ((F.col("x") != F.col("y")) | (F.col("m_x.k") < F.col("m_y.k"))))
    met = met.select(F.least("m_x", "m_y").alias("a"), F.greatest("m_x", "m_y").alias("b"), "jaccard")
    met = checkpointed(met.select(F.col("a.k").alias("key_a"), F.col("b.k").alias("key_b"), F.col("a.p").alias("party_a"), F.col("b.p").alias("party_b"), "jaccard"))
    one = among(vecs, "k", met.select(F.explode(F.array("key_a", "key_b")).alias("k"))).groupBy("k").agg(F.min("v").alias("v"))
    with_vectors = met.join(one.select(F.col("k").alias("key_a"), F.col("v").alias("v_a")), "key_a").join(one.select(F.col("k").alias("key_b"), F.col("v").alias("v_b")), "key_b").where(F.size("v_a") == F.size("v_b"))
    found = with_vectors.withColumn("cosine", cosine(F.col("v_a"), F.col("v_b"))).where((F.col("cosine") >= least_cosine) & ((F.col("jaccard") >= jaccard) | ((F.col("cosine") >= close[0]) & (F.col("jaccard") >= close[1]))))
    return found.select("key_a", "key_b", "party_a", "party_b", "cosine", "jaccard")


def among(df: DataFrame, key: str, wanted: DataFrame, hashes: str | None = None) -> DataFrame:
    """The rows of df whose key may be in wanted, without a shuffle of df: those whose hash hits a bit that a wanted key sets.

    hashes: the column of wanted that has the keys' hashes instead of the keys.

    The broadcast has at most FILTER_WORDS rows, whatever the input; the more keys, the more
    others pass, but never is a wanted one left out.
    """
    word = lambda h: F.pmod(h, F.lit(FILTER_WORDS)).cast("int")
    on = lambda h: F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))[F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")]
    h = F.col(hashes) if hashes else F.xxhash64(key)
    bits = wanted.select(word(h).alias("word"), on(h).alias("on")).groupBy("word").agg(F.bit_or("on").alias("bits"))
    marked = df.withColumns({"__word": word(F.xxhash64(key)), "__on": on(F.xxhash64(key))})
    return marked.join(F.broadcast(bits), (F.col("__word") == F.col("word")) & (F.col("bits").bitwiseAND(F.col("__on")) != 0), "left_semi").select(*df.columns)


def merged_links(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Both kinds of links, one row for each pair: exact wins, then the highest cosine; with kind."""
    both = exact.select("key_a", "key_b", "party_a", "party_b", F.lit(1.0).alias("cosine"), F.lit(1.0).alias("jaccard"), F.lit("exact_duplicate").alias("kind")).unionByName(near.withColumn("kind", F.lit("near_duplicate")))
    best = F.max_by(F.struct("party_a", "party_b", "cosine", "jaccard", "kind"), F.struct(F.col("kind") == "exact_duplicate", "cosine", "jaccard"))
    return both.groupBy("key_a", "key_b").agg(best.alias("b")).select("key_a", "key_b", "b.*")


def similar_sets(df: DataFrame, key: str, tokens: str, least: float = 0.8, hot: int = 20_000) -> DataFrame:
    """Pairs (key_a < key_b) of token sets with a Jaccard similarity of at least `least`, exact.

    One row of df for each set: equal sets should be one row, as set_classes() gives them. Prefix
    filter: only the rarest tokens of a set, as many as any similar set must share one of, are
    shuffled, each with the set's size and signature. Where sets meet, overlap.met() checks bounds
    of their overlap, and only the pairs that pass are written and compared token by token. Tokens
    are ordered by counts of a fixed number of buckets, keys and tokens known by 64-bit hashes. A
    token of many sets is split: its sets are dealt to blocks of about `hot`, pairs of which are
    tasks' work.
    """
    importable(df.sparkSession)
    sets = checkpointed(df.select(F.col(key).alias("k"), F.xxhash64(key).alias("id"), F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))).alias("t")).where(F.col("k").isNotNull() & (F.size("t") > 0)))
    near = overlapping(sets.select("id", "t"), least, hot)
    sides = near.select("x", "y", F.explode(F.array("x", "y")).alias("id")).join(sets, "id")
    one = lambda at: F.max(F.when(F.col("id") == F.col(at), F.struct("k", "t")))
    both = sides.groupBy("x", "y").agg(one("x").alias("a"), one("y").alias("b"))
    return both.select(F.least("a.k", "b.k").alias(f"{key}_a"), F.greatest("a.k", "b.k").alias(f"{key}_b"), shared_part(F.col("a.t"), F.col("b.t")).alias("jaccard")).where(F.col("jaccard") >= least)


def shared_part(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays of different tokens."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def overlapping(sets: DataFrame, least: float, hot: int) -> DataFrame:
    """x < y: ids of the pairs of sets (id, and t of different hashed tokens) that pass the bounds of their overlap. sets is read twice."""
    counted = sets.select(F.explode("t").alias("w")).groupBy(F.col("w").bitwiseAND(overlap.BUCKETS - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(overlap.BUCKETS, dtype=np.int64)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers, whatever the input
    probes = sets.select("id", "t").mapInArrow(lambda batches: overlap.probes(batches, shared.value, least, hot), overlap.PROBE)
    return probes.repartition("g").sortWithinPartitions("g", "size").mapInArrow(lambda batches: overlap.met(batches, least), overlap.MET).distinct()


def set_classes(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, class_key (the smallest key with the same token set) and members_n. Empty and null sets give no row."""
    rows = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    hashed = checkpointed(rows.select("k", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2")))
    classes = hashed.groupBy("h1", "h2").agg(F.min("k").alias("class_key"), F.count("*").alias("members_n"))
    return hashed.join(classes, ["h1", "h2"]).select(F.col("k").alias(key), "class_key", "members_n")
