"""Token ids of a whole corpus by content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it where the last WINDOW bytes say
so, wherever they stand; passages that documents share are thus cut alike. A
chunk that was seen before isn't encoded again: its core, from its first to its
last certain boundary, is looked up. The ends of neighbouring chunks are joined
and re-encoded up to these boundaries. A boundary is certain where a white space
follows another character: the pre-tokenizer's pattern has no alternative that
matches across it, whatever stands around, so both encodings agree from there on
and the result equals the encoding of the whole text. A chunk without such a
boundary is joined with the next, until there is one or the text ends.

The table of chunks is kept per Python worker under a bound in bytes; a chunk
that was dropped is encoded again. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from hemiciclo.llm.tables import buffered

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 8
MEAN_CHUNK = 256
TABLE_BYTES = 128 << 20
# U+001C..U+001F are white space to Python but not to the pattern
BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[^\S\x1c-\x1f])")
LAST_BOUNDARY = re.compile(r".*(?<=[^\s\x1c-\x1f])(?=[^\S\x1c-\x1f])", re.DOTALL)


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(data: np.ndarray, window: int, mean: int) -> np.ndarray:
    """Places in data (UTF-8 bytes) before which a chunk begins, by the bytes before them alone."""
    n = len(data) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(0x100000001B3) + mixed[k : k + n]
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + window
    return at[at < len(data)]


class ChunkTable:
    """Cores of chunks: text -> (head, ids, tail), or None for a chunk without two certain boundaries."""

    def __init__(self, encode, limit: int = TABLE_BYTES):
        self.encode, self.limit = encode, limit
        self.known: dict[bytes, tuple[str, list[int], str] | None] = {}
        self.size = self.hits = self.misses = 0

    def get(self, chunk: bytes):
        if chunk in self.known:
            self.hits += 1
            return self.known[chunk]
        self.misses += 1
        text = chunk.decode()
        found = BOUNDARY.search(text)
        core = None
        if found:
            first, last = found.start(), LAST_BOUNDARY.match(text).end()
            if last > first:
                core = text[:first], self.encode(text[first:last]), text[last:]
        self.size += 2 * len(chunk) + 36 * len(core[1] if core else ()) + 300
        if self.size > self.limit:
            self.known.clear()
            self.size = 0
        self.known[chunk] = core
        return core

    def ids(self, chunks: list[bytes]) -> list[int]:
        out: list[int] = []
        pending = ""
        for chunk in chunks:
            core = self.get(chunk)
            if core is None:
                pending += chunk.decode()
            else:
                head, ids, tail = core
                out += self.encode(pending + head)
                out += ids
                pending = tail
        if pending:
            out += self.encode(pending)
        return out


def encoded(batches: Iterable[pa.RecordBatch], text: str, name: str, vocabulary: str, window: int, mean: int, limit: int) -> Iterator[pa.RecordBatch]:
    chunks = ChunkTable(encoder(vocabulary).encode_ordinary, limit)
    for part in buffered(batches, 4096, 2 << 20):
        values, lengths = [], np.zeros(part.num_rows, dtype=np.int64)
        column = part[text].combine_chunks().cast(pa.large_binary()).fill_null(b"")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        used = data[: offsets[-1]]
        at = cuts(used, window, mean)
        for _ in range(3):  # a cut within a character moves behind it
            at = at + ((at < len(used)) & ((used[np.minimum(at, len(used) - 1)] & 0xC0) == 0x80))
        at = np.unique(at)
        # a text's cuts are those whose window lies within it, so that they depend on nothing else
        begin, end = np.searchsorted(at, offsets[:-1] + window), np.searchsorted(at, offsets[1:])
        whole = used.tobytes()
        for i in range(len(column)):
            if offsets[i] == offsets[i + 1]:
                continue
            edges = [int(offsets[i]), *at[begin[i] : end[i]].tolist(), int(offsets[i + 1])]
            ids = chunks.ids([whole[a:b] for a, b in zip(edges, edges[1:])])
            lengths[i] = len(ids)
            values.append(np.array(ids, dtype=np.int32))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int32)))
        kept = [c for c in part.column_names if c != text]
        yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks() for c in kept), lists], names=[*kept, name])


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "ids", vocabulary: str = VOCABULARY, window: int = WINDOW, mean_chunk: int = MEAN_CHUNK, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """key and the token ids of text, without special tokens.

    Null and empty texts give an empty list; nothing is trimmed or changed first; the
    string of a special token is ordinary text. Every row gives a row, repeated rows
    too; an empty table gives none. Texts of any length are encoded whole. Other
    columns of df are not read. vocabulary is a file of ranks that every executor has.
    """
    schema = StructType([df.schema[key], StructField(name, ArrayType(IntegerType()))])

    def run(batches):
        return encoded(batches, text, name, vocabulary, window, mean_chunk, table_bytes)

    return df.select(key, text).mapInArrow(run, schema)
