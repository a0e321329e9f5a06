"""Held-out texts inside a corpus, found with suffix arrays over shards of the corpus.

A text is read as words: maximal runs of letters and digits, without case and
accents. Each task packs its documents into shards of a bounded number of words
and sorts the shard's suffixes (by prefix doubling, up to `depth` words, the
most that decides). Every suffix of every test text is then searched in the
shard, all at once, by binary search. Matches of `words` words that follow each
other on both sides are one longer match; of each document and item the longest
verbatim match is given with its length and its places.

The test texts go to the tasks in blocks of a proven size: if they are more than
`block_chars`, the corpus is searched once for each block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hemiciclo.llm.tables import buffered

SHARD_BYTES = 6 << 20
BLOCK_CHARS = 8 << 20
WORDS = 20


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text, without case and accents; null texts have none."""
    plain = pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(pc.utf8_normalize(texts.fill_null(""), "NFC")), "NFD"), r"\p{M}+", "")
    return pc.split_pattern_regex(plain, r"[^\p{L}\p{N}]+")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and for each the number of its text."""
    lists = word_lists(texts)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    filled = pc.not_equal(flat, "")
    return flat.filter(filled), parent[filled.to_numpy(zero_copy_only=False)]


class Shard:
    """The suffixes of some texts in order, as far as `depth` words decide it."""

    def __init__(self, words: pa.Array, owner: np.ndarray, depth: int):
        coded = words.dictionary_encode()
        self.vocabulary, self.owner, self.depth = coded.dictionary, owner, depth
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # 0 ends a text; `depth` of them behind the last one spare the bounds checks
        ends = np.flatnonzero(np.diff(owner)) + 1
        places = np.arange(len(codes)) + np.searchsorted(ends, np.arange(len(codes)), side="right")
        self.text = np.zeros(len(codes) + len(ends) + depth, dtype=np.int64)
        self.text[places] = codes
        self.owner_at = np.full(len(self.text), -1, dtype=np.int64)
        self.owner_at[places] = owner
        self.places = places
        self.suffixes = self._sorted()

    def _sorted(self) -> np.ndarray:
        rank, step = self.text.copy(), 1
        while True:
            order = np.argsort(rank, kind="stable")
            if step >= self.depth:
                return order
            shifted = np.zeros_like(rank)
            shifted[:-step] = rank[step:]
            key = rank * (int(rank.max()) + 1) + shifted
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty_like(key)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(ordered) != 0)])
            step *= 2
            if rank.max() == len(rank) - 1:
                return order

    def codes(self, words: pa.Array) -> np.ndarray:
        """The words' codes; one that the shard doesn't have gets -1."""
        return pc.index_in(words, self.vocabulary).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def bounds(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of wanted (as many words each) the range of suffixes that begin with it."""
        return self._bound(wanted, False), self._bound(wanted, True)

    def _bound(self, wanted: np.ndarray, behind: bool) -> np.ndarray:
        width = np.arange(wanted.shape[1])
        low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(self.suffixes), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) // 2
            at = self.suffixes[mid][:, None] + width
            here = self.text[np.minimum(at, len(self.text) - 1)]
            differs = here != wanted[open_]
            some = differs.any(axis=1)
            first = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            smaller = some & (here[rows, first] < wanted[open_][rows, first])
            right = smaller | ~some if behind else smaller
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]


def longest(docs: np.ndarray, items: np.ndarray, at: np.ndarray, start: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Of each document and item the longest of their matches: document, item, words of the match, its places in both.

    Each row is a match of `words` words that begins at `at` and `start`; of equal lengths the first in the document counts.
    """
    order = np.lexsort((start, at - start, items, docs))
    docs, items, at, start = docs[order], items[order], at[order], start[order]
    fresh = np.ones(len(order), dtype=bool)  # a match goes on where the next begins one word later on both sides
    fresh[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(order))) + words - 1
    docs, items, at, start = docs[head], items[head], at[head], start[head]
    best = np.lexsort((start, at, -size, items, docs))
    docs, items, at, start, size = docs[best], items[best], at[best], start[best], size[best]
    first = np.ones(len(best), dtype=bool)
    first[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1])
    return docs[first], items[first], size[first], at[first], start[first]


PLACES = ("words_n", "doc_word", "item_word")


def found_in(part: pa.Table, key: str, text: str, item: str, test_words: pa.Array, test_owner: np.ndarray, items: list, words: int) -> pa.RecordBatch:
    schema = pa.schema([part.schema.field(key), pa.field(item, pa.array(items).type), *(pa.field(n, pa.int64()) for n in PLACES)])
    column = part[text].combine_chunks()
    flat, owner = words_of(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    none = np.empty(0, dtype=np.int64)
    hits = (none, none, none, none, none)
    if len(flat) >= words:
        shard = Shard(flat, owner, words)
        codes = shard.codes(test_words)
        starts = np.arange(max(0, len(codes) - words + 1))
        # a suffix counts if its first words are all of one item and all known to the shard
        unknown = np.concatenate([[0], np.cumsum(codes < 0)])
        starts = starts[(test_owner[starts] == test_owner[starts + words - 1]) & (unknown[starts + words] == unknown[starts])] if len(starts) else starts
        if len(starts):
            low, high = shard.bounds(codes[starts[:, None] + np.arange(words)])
            many = high - low
            which = np.repeat(starts, many)
            place = shard.suffixes[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            if len(which):
                doc, owned = shard.owner_at[place], test_owner[which]
                # places count within a document and an item, from 1
                begins = np.full(len(column), len(shard.text), dtype=np.int64)
                np.minimum.at(begins, owner, shard.places)
                item_begins = np.searchsorted(test_owner, np.arange(len(items)))
                hits = longest(doc, owned, place - begins[doc] + 1, which - item_begins[owned] + 1, words)
    keys = part[key].take(pa.array(hits[0])).combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) and keys.num_chunks else keys
    return pa.RecordBatch.from_arrays([keys, pa.array([items[k] for k in hits[1]], type=schema.field(1).type), *(pa.array(h, pa.int64()) for h in hits[2:])], schema=schema)


def longest_leaks(corpus: DataFrame, tests: DataFrame, key: str, text: str, item: str, item_text: str, words: int = WORDS, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key and item of every corpus text that contains `words` consecutive words of a test text, with the
    longest such match: words_n, and its first word in the document (doc_word) and in the item (item_word), from 1.

    Null, empty and shorter texts on either side give no rows; copies of a document
    each give their rows; an item that occurs several times in a document gives one.
    Rows with a null key or item take no part; other columns aren't read.
    """
    tests = tests.select(F.col(item).alias("item"), F.col(item_text).alias("words")).where("item IS NOT NULL AND words IS NOT NULL")
    chars = tests.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    corpus = corpus.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    schema = StructType([corpus.schema[key], StructField(item, tests.schema["item"].dataType), *(StructField(n, LongType()) for n in PLACES)])
    out: DataFrame | None = None
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about block_chars characters
        items = [r["item"] for r in rows]
        flat, owner = words_of(pa.array([r["words"] for r in rows], pa.string()))
        if len(flat) < words:
            continue

        def run(batches: Iterable[pa.RecordBatch], flat=flat, owner=owner, items=items) -> Iterator[pa.RecordBatch]:
            for part in buffered(batches, 1 << 20, shard_bytes):
                yield found_in(part, key, text, item, flat, owner, items, words)

        found = corpus.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    # a document lies in one shard, so only repeated rows could repeat a pair
    found = out if out is not None else corpus.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("words_n", (-F.col("doc_word")).alias("doc"), (-F.col("item_word")).alias("own"))).alias("best")
    return found.groupBy(key, item).agg(best).select(key, item, "best.words_n", (-F.col("best.doc")).alias("doc_word"), (-F.col("best.own")).alias("item_word"))


def leaked(corpus: DataFrame, tests: DataFrame, key: str, text: str, item: str, item_text: str, **options) -> DataFrame:
    """key and item of every corpus text that contains so many consecutive words of a test text, as longest_leaks() finds them."""
    return longest_leaks(corpus, tests, key, text, item, item_text, **options).select(key, item)
