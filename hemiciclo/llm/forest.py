"""The most similar vectors of every vector, by a forest of hash prefixes.

A tree gives each vector a long string of bits, the sides of random hyperplanes it
lies on, and is the sorted array of these strings. Rows are shuffled by tree and
the first bits; the rows of a prefix that holds too many are hashed again as seen from
one of them, which parts even a narrow bundle of directions. A task sorts its
rows and descends: the array is halved at the next bit as long as both parts keep
at least `least` rows and the whole has more than `leaf`, so similar vectors end
below a prefix as long as their density allows; where a part would be smaller, it
ascends: its rows and all of its sibling's see each other, and the sibling goes on.
Below each prefix all cosines are taken at once. A row's nearest of each tree are
united and their cosines taken exactly.

Vectors of one direction are searched as one: each of them has the same
neighbours, so `k + 1` of its smallest keys stand for it, however many it has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from hemiciclo.llm.tables import buffered, checkpointed
from hemiciclo.llm.topn import top_n

TREES = 14
LEAF = 1024
LEAST = 48
BUCKET_ROWS = 16_384
BITS = 60
BLOCK = 8192  # rows at a time that the few of a small part see


def planes(tree: int, width: int, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng([17, tree, width]).standard_normal((width, bits)).astype(np.float32)


def bit_strings(units: np.ndarray, tree: int) -> np.ndarray:
    """The first BITS bits of each row's string, as a number whose order is that of the strings."""
    sides = (units @ planes(tree, units.shape[1])) > 0
    return sides.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def leaves(codes: np.ndarray, units: np.ndarray, leaf: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows below each prefix, with None, or two sets of rows that see each other.

    codes are sorted; where the bits don't tell rows apart, their projections do.
    """
    stack = [(0, len(codes), BITS - 1)]
    while stack:
        a, z, bit = stack.pop()
        if z - a <= leaf:
            yield np.arange(a, z), None
        elif bit < 0:
            yield from ((rows, None) for rows in halved(np.arange(a, z), units, leaf, 0))
        else:
            cut = a + int(np.searchsorted(codes[a:z] >> bit & 1, 1))
            if min(cut - a, z - cut) >= least:
                stack += [(a, cut, bit - 1), (cut, z, bit - 1)]
            elif cut in (a, z):
                stack.append((a, z, bit - 1))
            else:  # the few of the smaller part are searched with all of the larger one, which goes on without them
                few, many = ((a, cut), (cut, z)) if cut - a < z - cut else ((cut, z), (a, cut))
                head = min(many[1], many[0] + max(0, leaf - (few[1] - few[0])))
                yield np.concatenate([np.arange(*few), np.arange(many[0], head)]), None
                for start in range(head, many[1], BLOCK):
                    yield np.arange(*few), np.arange(start, min(many[1], start + BLOCK))
                stack.append((*many, bit - 1))


def halved(rows: np.ndarray, units: np.ndarray, leaf: int, depth: int) -> Iterator[np.ndarray]:
    """Rows that share all bits, cut at the median of a random direction within their own spread."""
    if len(rows) <= leaf or depth > 40:
        for a in range(0, len(rows), leaf):
            yield rows[a : a + leaf]
        return
    spread = units[rows] - units[rows].mean(axis=0)
    order = np.argsort(spread @ planes(1000 + depth, units.shape[1], 1)[:, 0], kind="stable")
    yield from halved(rows[order[: len(rows) // 2]], units, leaf, depth + 1)
    yield from halved(rows[order[len(rows) // 2 :]], units, leaf, depth + 1)


class Nearest:
    """The `keep` nearest that each row has met so far, at about least_cosine or above."""

    def __init__(self, rows: int, keep: int, least_cosine: float):
        self.floor = least_cosine - 1e-4
        self.cosine = np.full((rows, keep), -3, np.float32)
        self.other = np.full((rows, keep), -1, np.int64)

    def meet(self, rows: np.ndarray, others: np.ndarray, s: np.ndarray) -> None:
        """Let rows see others; s has their cosines."""
        keep = self.cosine.shape[1]
        own = self.cosine[rows]
        live = np.flatnonzero((s.max(axis=1) >= self.floor) & (s.max(axis=1) > own.min(axis=1)))
        if not len(live):
            return
        s, rows = s[live], rows[live]
        at = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if s.shape[1] > keep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        met = (others[at][:, :, None] == self.other[rows][:, None, :]).any(axis=2)
        cosine = np.concatenate([own[live], np.where(met, np.float32(-3), np.take_along_axis(s, at, 1))], axis=1)
        other = np.concatenate([self.other[rows], others[at]], axis=1)
        best = np.argpartition(-cosine, keep - 1, axis=1)[:, :keep]
        self.cosine[rows], self.other[rows] = np.take_along_axis(cosine, best, 1), np.take_along_axis(other, best, 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.cosine >= max(self.floor, -1.5))
        return row, self.other[row, place]


def directions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, embedding): key, the direction's unit vector and a hash of it; zero and broken vectors are left out."""
    for b in batches:
        keys, units, hashes = [], [], []
        for key, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.array([np.nan if x is None else x for x in values], dtype=np.float64)
            if not len(v) or not np.isfinite(v).all() or not v.any():
                continue
            v = v / np.abs(v).max()
            v /= np.linalg.norm(v)
            keys.append(key)
            units.append(v.tobytes())
            hashes.append((np.round(v, 10) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(units, pa.binary()), pa.array(hashes, pa.binary())], names=["key", "unit", "rounded"])


def strings(batches: Iterable[pa.RecordBatch], trees: int, bits: int, hot: dict[tuple[int, int, int], tuple[int, bytes]], bare: bool) -> Iterator[pa.RecordBatch]:
    """Of (dir, unit): for each tree a row with the prefix that it is shuffled by, and its string."""
    for part in buffered(batches, 8192):
        dirs = part["dir"].to_numpy()
        raw = part["unit"].to_pylist()
        widths = np.array([len(u) // 8 for u in raw])
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            units = np.frombuffer(b"".join(raw[i] for i in rows), dtype=np.float64).reshape(len(rows), width).astype(np.float32)
            packed = pa.array([u.tobytes() for u in units], pa.binary())
            for tree in range(trees):
                code = bit_strings(units, tree)
                prefix = code >> (BITS - bits)
                for p in np.unique(prefix) if hot else ():
                    if (crowd := hot.get((int(width), tree, int(p)))) is not None:
                        more, seen_from = crowd
                        own = np.flatnonzero(prefix == p)
                        code[own] = bit_strings(units[own] - np.frombuffer(seen_from, dtype=np.float32), 500 + tree)
                        prefix[own] = p << more | code[own] >> (BITS - more) | np.int64(1) << 61
                names = ["width", "tree", "prefix", "u"]
                out = [pa.array(np.full(len(rows), width, np.int32)), pa.array(np.full(len(rows), tree, np.int32)), pa.array(prefix), packed]
                if not bare:
                    out += [pa.array(code), pa.array(dirs[rows])]
                    names += ["code", "dir"]
                yield pa.RecordBatch.from_arrays(out, names=names)


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, least_cosine: float = -1.0, trees: int = TREES, leaf: int = LEAF, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The k keys of highest cosine to each key: columns key, neighbour, cosine.

    One row of df for each key. Neighbours below least_cosine are left out. Equal cosines:
    the smaller key (byte order) first. Null, empty, all-zero and non-finite vectors take no
    part; vectors of different widths aren't compared. The search is approximate: all rows are
    indexed, in every tree; a neighbour that no tree brings below one prefix is missed.
    Fewer than two vectors give no rows; extra columns aren't read.
    """
    spark = df.sparkSession
    fields = StructType([StructField("key", StringType()), StructField("unit", BinaryType()), StructField("rounded", BinaryType())])
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
    members = checkpointed(rows.mapInArrow(directions, fields).select("key", "unit", F.xxhash64("rounded").alias("dir")))
    dirs = members.groupBy("dir").agg(F.min(F.struct("key", "unit")).alias("m"), F.count("*").alias("n")).select("dir", "m.key", "m.unit", "n")
    dirs = checkpointed(dirs)
    many = dirs.count()
    bits = max(0, min(24, ceil(log2(max(1, many) / bucket_rows)))) if many > bucket_rows else 0
    hot: dict = {}
    if bits:
        head = StructType([StructField("width", IntegerType()), StructField("tree", IntegerType()), StructField("prefix", LongType()), StructField("u", BinaryType())])

        def prefixes(batches):
            return strings(batches, trees, bits, {}, True)

        # at most trees * many / (4 * bucket_rows) prefixes hold that many rows
        crowded = dirs.select("dir", "unit").mapInArrow(prefixes, head).groupBy("width", "tree", "prefix").agg(F.count("*").alias("n"), F.min("u").alias("u")).where(F.col("n") > 4 * bucket_rows).collect()
        hot = {(r["width"], r["tree"], r["prefix"]): (ceil(log2(r["n"] / bucket_rows)) + 2, bytes(r["u"])) for r in crowded}
    body = StructType([StructField("width", IntegerType()), StructField("tree", IntegerType()), StructField("prefix", LongType()), StructField("u", BinaryType()), StructField("code", LongType()), StructField("dir", LongType())])

    def grow(batches):
        return strings(batches, trees, bits, hot, False)

    def search(table: pa.Table) -> pa.Table:
        code = table["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        units = np.frombuffer(b"".join(table["u"].to_pylist()), dtype=np.float32).reshape(len(code), -1)[order]
        ids, best = table["dir"].to_numpy()[order], Nearest(len(code), k + 2, least_cosine)
        for below, beside in leaves(code[order], units, leaf, LEAST):
            s = units[below] @ units[below if beside is None else beside].T
            if beside is None:
                np.fill_diagonal(s, -2)
                best.meet(below, below, s)
            else:
                best.meet(below, beside, s)
                best.meet(beside, below, s.T)
        a, b = best.pairs()
        return pa.table({"a": ids[a], "b": ids[b]})

    pair = StructType([StructField("a", LongType()), StructField("b", LongType())])
    candidates = dirs.select("dir", "unit").mapInArrow(grow, body).groupBy("width", "tree", "prefix").applyInArrow(search, pair).distinct()
    units = dirs.select("dir", "unit")
    found = candidates.join(units.select(F.col("dir").alias("a"), F.col("unit").alias("ua")), "a").join(units.select(F.col("dir").alias("b"), F.col("unit").alias("ub")), "b")

    def cosines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos, pa.float64())], names=["a", "b", "cosine"])

    scored = found.select("a", "b", "ua", "ub").mapInArrow(cosines, StructType([*pair, StructField("cosine", DoubleType())])).where(F.col("cosine") >= least_cosine)
    # the smallest keys of each direction; almost all have one
    few = top_n(members.join(dirs.where("n > 1").select("dir"), "dir", "left_semi").select(F.col("dir").cast("string").alias("dir"), "key", F.lit(0.0).alias("score")), ["dir"], "key", "score", k + 1)
    keys = dirs.where("n = 1").select("dir", "key").unionByName(few.select(F.col("dir").cast("long"), "key"))
    # a direction has at most k + 2 neighbours for each tree, with at most k + 1 keys each
    others = scored.join(keys.withColumnRenamed("dir", "b"), "b").select("a", "key", "cosine")
    own = keys.join(dirs.where("n > 1").select("dir"), "dir", "left_semi").select(F.col("dir").alias("a"), "key", F.lit(1.0).alias("cosine"))
    lists = others.unionByName(own).groupBy("a").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), F.col("key").alias("neighbour")))).alias("list"))
    lists = lists.select(F.col("a").alias("dir"), F.slice("list", 1, k + 1).alias("list"))  # one of k + 1 may be the key itself
    return (
        members.select("key", "dir").join(lists, "dir")
        .select("key", F.explode(F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("key")), 1, k)).alias("x"))
        .select(F.col("key").alias(key), F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cosine"))
    )
