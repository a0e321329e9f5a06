"""Top N items of every group by simultaneous bisection.

Score and identifier make one integer code whose order is the wanted order, so
codes within a group are distinct. All groups are bisected at once: each has an
interval of codes, the rows above every midpoint are counted in one pass, and
the interval halves until exactly N rows (or all, if fewer) lie above the cutoff.

Two levels keep the work local. Each task bisects the groups within its own rows
before anything moves: what isn't among a task's N best distinct items of a group
can't be among the group's N best. So at most N rows for each group and task are
shuffled, whatever the size of the group, and the second level bisects these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hemiciclo.llm.tables import buffered

BUFFER_ROWS = 1 << 17


def bisect_groups(group: np.ndarray, code: np.ndarray, groups: int, n: int) -> np.ndarray:
    """Mask of the n highest codes of each group. Codes are distinct within a group."""
    size = np.bincount(group, minlength=groups)
    chosen = size[group] <= n
    rows = np.flatnonzero(~chosen)
    if not len(rows):
        return chosen
    g, c = group[rows], code[rows]
    low = np.full(groups, np.iinfo(np.int64).max)
    high = np.full(groups, -1, dtype=np.int64)
    np.minimum.at(low, g, c)
    np.maximum.at(high, g, c)
    low -= 1  # more than n rows lie above low, fewer above high
    cut = np.zeros(groups, dtype=np.int64)
    while len(rows):
        mid = low + (high - low) // 2
        above = c > mid[g]
        count = np.bincount(g[above], minlength=groups)
        done = count == n
        cut = np.where(done, mid, cut)
        low, high = np.where(count > n, mid, low), np.where(count < n, mid, high)
        ended = done[g]
        chosen[rows[ended & above]] = True
        rows, g, c = rows[~ended], g[~ended], c[~ended]
    return chosen


def dense(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Codes 0.. of a column's values, in any order."""
    coded = column.combine_chunks().dictionary_encode()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))


def ranks(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Codes 0.. of a column's values that keep their order (strings: byte order)."""
    coded = column.combine_chunks().dictionary_encode()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], max(1, len(order))


def best(part: pa.Table, keys: list[str], item: str, score: str, n: int) -> pa.Table:
    """The n best distinct items of each group of part, each with its highest score."""
    group = np.zeros(part.num_rows, dtype=np.int64)
    for key in keys:
        code, many = dense(part[key])
        group = np.unique(group * many + code, return_inverse=True)[1]
    id_rank, ids = ranks(part[item])
    # -0.0 and 0.0 are equal scores
    score_rank, _ = ranks(pa.chunked_array([pa.array(part[score].to_numpy() + 0.0)]))
    code = score_rank * ids + (ids - 1 - id_rank)
    # an item that repeats within a group counts once, with its highest score
    order = np.lexsort((-code, id_rank, group))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(group[order]) != 0) | (np.diff(id_rank[order]) != 0)
    kept = np.sort(order[first])
    group, code = group[kept], code[kept]
    groups = int(group.max()) + 1 if len(group) else 0
    return part.take(pa.array(kept[bisect_groups(group, code, groups, n)]))


def folded(batches: Iterable[pa.RecordBatch], keys: list[str], item: str, score: str, n: int, buffer_rows: int) -> Iterator[pa.RecordBatch]:
    """best() over all rows of a task, a buffer at a time: the survivors go on with the next buffer."""
    kept: pa.Table | None = None
    for part in buffered(batches, buffer_rows):
        kept = best(part if kept is None else pa.concat_tables([kept, part]), keys, item, score, n)
        if kept.num_rows > buffer_rows:  # many small groups: let those rows go on, the next level settles them
            yield from kept.combine_chunks().to_batches(max_chunksize=10_000)
            kept = None
    if kept is not None:
        yield from kept.combine_chunks().to_batches(max_chunksize=10_000)


def top_n(df: DataFrame, keys: list[str], item: str, score: str, n: int, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """The n rows of highest score of every group, as columns keys, item and score.

    keys and item are string columns, score a double. Ties: the smaller item (byte
    order) first. An item counts once in its group, with its highest score. Rows
    with a null in keys, item or score, or a NaN score, take no part. Groups of
    fewer than n items give all they have; n < 1 and empty input give no rows.
    Other columns of df, whatever their names, are not read.
    """
    if n < 1:
        return df.select(*keys, item, score).limit(0)
    schema = StructType([*(StructField(k, StringType()) for k in [*keys, item]), StructField(score, DoubleType())])
    usable = F.lit(True)
    for c in [*keys, item, score]:
        usable &= F.col(c).isNotNull()
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in [*keys, item]), F.col(score).cast("double").alias(score)).where(usable & ~F.isnan(score))

    def local(batches):
        return folded(batches, keys, item, score, n, buffer_rows)

    def final(batches):
        # a group's rows all lie in this task; nothing may leave before its end
        kept: pa.Table | None = None
        pending: list[pa.Table] = []
        waiting = 0
        for part in buffered(batches, buffer_rows):
            pending.append(part)
            waiting += part.num_rows
            if waiting >= (kept.num_rows if kept is not None else 0):  # each fold at least doubles what is new: linear work
                kept = best(pa.concat_tables(([kept] if kept is not None else []) + pending), keys, item, score, n)
                pending, waiting = [], 0
        if pending or kept is not None:
            kept = best(pa.concat_tables(([kept] if kept is not None else []) + pending), keys, item, score, n) if pending else kept
            yield from kept.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.mapInArrow(local, schema).repartition(*keys).mapInArrow(final, schema)
