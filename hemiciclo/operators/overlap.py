"""Which token sets may be similar: bounds on their overlap, checked in Arrow batches where sets share a rare token.

No pair is written but those that pass the bounds, and the bounds lose none: for a Jaccard
similarity of t two sets of m and n tokens share at least t / (1 + t) * (m + n) of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BUCKETS = 1 << 18  # of the counts by which tokens are ordered; any order is right, the more exact one meets fewer pairs
WORDS, FIRST = 4, 2  # 64-bit words of a set's signature, and those that are compared first
SMALL, CELLS = 32, 1 << 16  # sets of a token that are paired together with other tokens'; cells of a block of pairs
EPS = 1e-6
PROBE = "g long, id long, size int, after int, side int, " + ", ".join(f"s{i} long" for i in range(WORDS))
MET = "x long, y long"


def bucket(tokens: np.ndarray) -> np.ndarray:
    return tokens & (BUCKETS - 1)


def signatures(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each set which of 64 * WORDS classes hold an odd number of its tokens: no more differ than tokens do."""
    at = (tokens.view(np.uint64) >> np.uint64(32)) % np.uint64(64 * WORDS)
    bits = np.zeros((len(tokens), WORDS), dtype=np.uint64)
    bits[np.arange(len(tokens)), (at >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (at & np.uint64(63))
    return np.bitwise_xor.reduceat(bits, starts, axis=0)


def probes(batches: Iterable[pa.RecordBatch], counts: np.ndarray, least: float, hot: int) -> Iterator[pa.RecordBatch]:
    """From id and t (different hashed tokens) a row for each token of a set's prefix: the rarest
    ones, of which it shares one with any similar set.

    The sets of a token of more than `hot` are dealt to blocks, and a group g is a pair of blocks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, sizes = batch["id"].to_numpy(), batch["t"].value_lengths().to_numpy()
        tokens = batch["t"].flatten().to_numpy()
        row, starts = np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes) - sizes
        sig = signatures(tokens, starts)
        often = counts[bucket(tokens)]
        order = np.lexsort((tokens, often, row))
        place = np.arange(len(row)) - starts[row]
        prefix = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
        kept = order[(place < prefix[row]) & (often[order] > 1)]  # a token of one set meets none
        after = (sizes[row] - place - 1)[(place < prefix[row]) & (often[order] > 1)]
        w, r = tokens[kept], row[kept]
        parts = -(-often[kept] // hot)
        own = (ids[r].view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts
        again = np.repeat(np.arange(len(w)), parts)
        other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        w, r, after, own, parts = w[again], r[again], after[again], own[again], parts[again]
        pair = (np.minimum(own, other) * parts + np.maximum(own, other)).view(np.uint64)
        g = (w.view(np.uint64) ^ (pair * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
        side = np.where(own == other, -1, own)
        out = [g, ids[r], sizes[r].astype(np.int32), after.astype(np.int32), side.astype(np.int32), *(sig[r, i].view(np.int64) for i in range(WORDS))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["g", "id", "size", "after", "side", *(f"s{i}" for i in range(WORDS))])


def met(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From probes sorted by g and size the ids of pairs that pass the bounds; a pair may come more than once."""
    rest: list[np.ndarray] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(rest, columns)] if rest else columns
        if len(columns[0]):
            whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            rest = [c[whole:] for c in columns]
            yield from _within([c[:whole] for c in columns], least)
    if rest:
        yield from _within(rest, least)


def _within(columns: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    g, ids, size, after, side = columns[:5]
    if len(g) < 2:
        return
    sig = np.stack(columns[5:], axis=1).view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    ends = np.append(starts[1:], len(g))
    apart = (1 - least) / (1 + least)

    def passed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        both = size[a] + size[b]
        ok = ((side[a] != side[b]) | (side[a] < 0)) & (ids[a] != ids[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - EPS)
        # if this is the first token that they share, all others stand behind it
        ok &= np.minimum(after[a], after[b]) + 1 >= least / (1 + least) * both - EPS
        a, b, both = a[ok], b[ok], both[ok]
        ok = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1) <= apart * both + EPS
        x, y = ids[a[ok]], ids[b[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"]) if len(x) else None

    bound = np.minimum(np.floor(size * apart + EPS) + 1, 127).astype(np.uint8)  # two of them are no less than the bound of a pair
    few = ends - starts <= SMALL
    end = np.repeat(np.where(few, ends, 0), ends - starts)
    a = np.arange(len(g))
    for step in range(1, SMALL):
        a = a[a + step < end[a]]
        if not len(a):
            break
        if out := passed(a, a + step):
            yield out
    for first, end_ in zip(starts[~few], ends[~few]):
        begin = int(first)
        while begin < end_ - 1:
            stop = min(begin + max(8, CELLS // int(end_ - begin)), int(end_))
            # sorted by size: no similar set lies beyond
            far = begin + int(np.searchsorted(size[begin:end_], size[stop - 1] / least + EPS, side="right"))
            differ = np.bitwise_count(sig[begin:stop, None, 0] ^ sig[None, begin:far, 0])
            for i in range(1, FIRST):
                differ += np.bitwise_count(sig[begin:stop, None, i] ^ sig[None, begin:far, i])
            y, x = np.divmod(np.flatnonzero(differ <= bound[begin:stop, None] + bound[None, begin:far]), far - begin)
            y, x = y[x > y], x[x > y]
            if out := passed(begin + y, begin + x):
                yield out
            begin = stop
