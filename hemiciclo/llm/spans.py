"""Long exact spans that texts share with texts of other owners.

Every stretch of `length` characters holds a whole block, wherever blocks of
(length + 1) / 2 characters are laid side by side from a text's start. So the
non-overlapping blocks of all texts are indexed by hash, each with the smallest
and largest owner it has, and every rolling window of a text probes this index:
a window hits if its block stands with another owner. A window probes a Bloom filter of
the index first, in its own task, so that only those which may hit are shuffled; the
filter has at most FILTER_BITS bits, and a larger index is probed in several passes, each
over the blocks and windows of one range of hashes. Hits say where a stretch can lie;
there they are extended: the windows of `length` characters around them are
compared by hash, again each with its smallest and largest owner, and those with
two owners are shared. Their union are the maximal spans.

A hash that stands with two owners is all that is asked, so nothing grows with the
number of copies: no pairs of texts are made, equal texts are read once, and
counts are combined before they are shuffled. Hashes are pairs of polynomials
modulo 2^61-1 and 2^64, of 125 bits together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from hemiciclo.llm.tables import buffered, checkpointed

LENGTH = 160
SALTS = 8
FILTER_BITS = 1 << 28  # 32 MB
BITS_A_BLOCK = 12
CHUNK_WORDS = 2048  # words of the filter that are put together in one group
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(codes: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    """A 64-bit hash of every window of so many characters, by doubling: of 1, 2, 4 ... characters."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power, size = mixed(codes.astype(np.uint64) + np.uint64(1), by), 1
    out, done = None, 0
    while True:
        if width & size:
            out = power[done : done + n] if out is None else mixed(out * by + power[done : done + n], by)
            done += size
        if done == width:
            return out
        power = mixed(power[:-size] * by + power[size:], by)
        size *= 2


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def columns(**arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_and_mask(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a hash falls on, and its four bits in it."""
    x = h.view(np.uint64)
    mask = np.zeros(len(x), dtype=np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), mask


def in_pass(h: np.ndarray, number: int, passes: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(24) & np.uint64(255)) % np.uint64(passes) == np.uint64(number)


def hashed(batches: Iterable[pa.RecordBatch], width: int, step: int, keep=None) -> Iterator[pa.RecordBatch]:
    """Of texts (text, tid, tid2, lo, hi): h, tid, tid2, start, lo and hi of every step-th window that keep lets pass."""
    for part in buffered(batches, 2000, 1 << 20):
        rows = []
        for text, tid, tid2, lo, hi in zip(*(part[c].to_pylist() for c in ("text", "tid", "tid2", "lo", "hi"))):
            h = signed(rolling(characters(text), width, MIX1)[::step])
            at = np.arange(len(h), dtype=np.int64) if keep is None else np.flatnonzero(keep(h))
            if len(at):
                rows.append((h[at], tid, tid2, at * step, lo, hi))
        if rows:
            n = [len(r[0]) for r in rows]
            yield columns(h=np.concatenate([r[0] for r in rows]), tid=np.repeat([r[1] for r in rows], n), tid2=np.repeat([r[2] for r in rows], n), start=np.concatenate([r[3] for r in rows]), lo=np.repeat([r[4] for r in rows], n), hi=np.repeat([r[5] for r in rows], n))


LONGS = lambda *names: StructType([StructField(n, LongType()) for n in names])


def bloom(index: DataFrame, number: int, passes: int, words: int) -> np.ndarray:
    """The filter of one pass's blocks, of so many words; its chunks are put together on the executors."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            word, mask = word_and_mask(h[in_pass(h, number, passes)], words)
            yield columns(chunk=word // CHUNK_WORDS, word=word % CHUNK_WORDS, mask=signed(mask))

    def chunk(table: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK_WORDS, dtype=np.uint64)
        np.bitwise_or.at(out, table["word"].to_numpy(), table["mask"].to_numpy().view(np.uint64))
        return pa.table({"chunk": table["chunk"].slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    kept = StructType([StructField("chunk", LongType()), StructField("bits", BinaryType())])
    found = index.select("h").mapInArrow(placed, LONGS("chunk", "word", "mask")).groupBy("chunk").applyInArrow(chunk, kept).collect()  # at most FILTER_BITS
    out = np.zeros(-(-words // CHUNK_WORDS) * CHUNK_WORDS, dtype=np.uint64)
    for r in found:
        out[r["chunk"] * CHUNK_WORDS : (r["chunk"] + 1) * CHUNK_WORDS] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


def shared_spans(df: DataFrame, key: str, owner: str, text: str, length: int = LENGTH, name: str = "span", filter_bits: int = FILTER_BITS) -> DataFrame:
    """key, span_start and span_end (both inclusive, from 1) of the maximal runs of characters that
    lie in stretches of `length` characters which stand verbatim in a text of another owner.

    One row of df for each key. Null texts and owners take no part, texts shorter than
    length have no spans; a stretch that only repeats within one owner isn't shared.
    Extra columns aren't read; an empty table gives no rows. filter_bits bounds the Bloom
    filter that goes to the tasks at once.
    """
    if length < 2:
        raise ValueError("a stretch has at least 2 characters")
    rows = df.select(F.col(key).alias("key"), F.xxhash64(owner).alias("owner"), F.col(text).alias("text")).where(
        F.col(key).isNotNull() & F.col(owner).isNotNull() & (F.length(text) >= length)
    )
    ids = lambda d: d.withColumns({"tid": F.xxhash64("text", F.length("text")), "tid2": F.xxhash64(F.lit(7), "text")})
    texts = ids(rows.groupBy("text").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")))
    block = (length + 1) // 2

    def blocks_of(batches):
        return hashed(batches, block, block)

    fields = LONGS("h", "tid", "tid2", "start", "lo", "hi")
    index = checkpointed(texts.mapInArrow(blocks_of, fields).groupBy("h").agg(F.min("lo").alias("blo"), F.max("hi").alias("bhi")))
    many = index.count()
    passes = min(256, max(1, -(-many * BITS_A_BLOCK // filter_bits)))
    words = max(1, min(filter_bits, many * BITS_A_BLOCK // passes) // 64)
    hits: DataFrame | None = None
    for number in range(passes):
        shared = df.sparkSession.sparkContext.broadcast(bloom(index, number, passes, words))  # FILTER_BITS at most

        def windows_of(batches, number=number, shared=shared):
            bits = shared.value

            def keep(h: np.ndarray) -> np.ndarray:
                word, mask = word_and_mask(h, words)
                fits = bits[word] & mask == mask
                return fits & in_pass(h, number, passes) if passes > 1 else fits

            return hashed(batches, block, 1, keep)

        # the index is the build side: it has one row for each block, a window finds at most one
        probes = texts.mapInArrow(windows_of, fields)
        found = probes.join(index.hint("shuffle_hash"), "h").where("blo <> lo OR bhi <> hi OR lo <> hi").select("tid", "tid2", "start")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("tid", "tid2").agg(F.collect_list("start").alias("starts"))  # bounded by the text's own length

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in buffered(batches, 500, 1 << 20):
            rows = []
            for text, tid, tid2, lo, hi, starts in zip(*(part[c].to_pylist() for c in ("text", "tid", "tid2", "lo", "hi", "starts"))):
                chars = characters(text)
                n = len(chars) - length + 1
                # a stretch around a hit begins at most length - block before it
                mark = np.zeros(n + 1, dtype=np.int64)
                at = np.array(starts, dtype=np.int64)
                np.add.at(mark, np.minimum(np.maximum(0, at - (length - block)), n), 1)
                np.add.at(mark, np.minimum(at + 1, n), -1)
                where = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                if len(where):
                    rows.append((rolling(chars, length, MIX1)[where], rolling(chars, length, MIX2)[where], tid, where, lo, hi, tid2))
            if rows:
                m = [len(r[3]) for r in rows]
                yield columns(h=signed(np.concatenate([r[0] for r in rows])), h2=signed(np.concatenate([r[1] for r in rows])), tid=np.repeat([r[2] for r in rows], m), tid2=np.repeat([r[6] for r in rows], m), start=np.concatenate([r[3] for r in rows]), lo=np.repeat([r[4] for r in rows], m), hi=np.repeat([r[5] for r in rows], m))

    near = texts.join(hits, ["tid", "tid2"]).select("text", "tid", "tid2", "lo", "hi", "starts").mapInArrow(stretches, LONGS("h", "h2", "tid", "tid2", "start", "lo", "hi"))
    common = near.groupBy("h", "h2").agg(F.min("lo").alias("clo"), F.max("hi").alias("chi")).where("clo <> chi").select("h", "h2")
    # a stretch that very many texts have is spread over SALTS tasks
    common = common.withColumn("salt", F.explode(F.array(*(F.lit(s) for s in range(SALTS)))))
    starts = near.withColumn("salt", F.pmod(F.hash("tid"), F.lit(SALTS))).join(common, ["h", "h2", "salt"], "left_semi").groupBy("tid", "tid2").agg(F.sort_array(F.collect_set("start")).alias("starts"))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tid, tid2, starts in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = np.array(starts, dtype=np.int64)
                cut = np.flatnonzero(np.diff(s) > length)  # touching stretches are one run
                out += [(tid, tid2, int(a) + 1, int(z) + length) for a, z in zip(s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])])]
            yield columns(**{c: np.array([o[i] for o in out], np.int64) for i, c in enumerate(("tid", "tid2", "a", "z"))})

    spans = starts.mapInArrow(runs, LONGS("tid", "tid2", "a", "z"))
    return ids(rows).select("key", "tid", "tid2").join(spans, ["tid", "tid2"]).select(F.col("key").alias(key), F.col("a").alias(f"{name}_start"), F.col("z").alias(f"{name}_end"))
