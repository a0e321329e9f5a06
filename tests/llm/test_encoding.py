import os
import random

import pytest
from pyspark.sql import functions as F

from hemiciclo.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary here")
PIECES = ["plan ", "el déficit de agua", "\n\n", "  ", "don't we'll 's'll", "'", "12345", "ñandú", "公共用水", "🇵🇪🚰", "​", "\x1c\x1d", "<|endoftext|>", "\t", ".", "a" * 50, " " * 40, "́", "¡Sí!", " "]


def test_chunks_give_the_encoding_of_the_whole_text():
    encode = encoding.encoder(encoding.VOCABULARY).encode_ordinary
    table = encoding.ChunkTable(encode, 200_000)
    r = random.Random(2)
    for _ in range(1500):
        raw = "".join(r.choices(PIECES, k=r.randrange(1, 40))).encode()
        # any cut between characters must give the same ids
        at = sorted({0, len(raw), *(k for k in r.choices(range(len(raw)), k=6) if raw[k] & 0xC0 != 0x80)})
        assert table.ids([raw[a:b] for a, b in zip(at, at[1:])]) == encode(raw.decode())


def test_table_of_texts(spark):
    passage = "El déficit de 404 camas en los barrios obliga a financiar el incentivo de bosques ribereños. " * 30
    texts = [None, "", " ", passage, passage, "x" + passage, "don't", "<|endoftext|>", "ab " * 40_000, "z" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(9)).withColumn("n", F.lit(0))
    out = {r.doc_id: r.ids for r in encoding.encode_corpus(df, "doc_id", "text", mean_chunk=32).collect()}
    encode = encoding.encoder(encoding.VOCABULARY).encode_ordinary
    assert out == {k: encode(t or "") for k, t in enumerate(texts)}
    empty = encoding.encode_corpus(df.limit(0), "doc_id", "text")
    assert empty.columns == ["doc_id", "ids"] and empty.count() == 0


def test_shared_passages_are_encoded_once():
    table = encoding.ChunkTable(encoding.encoder(encoding.VOCABULARY).encode_ordinary)
    import numpy as np

    shared = " ".join(str(k * k) for k in range(2000))
    for start in ("", "otra introducción: ", "x"):
        raw = (start + shared).encode()
        at = [0, *encoding.cuts(np.frombuffer(raw, np.uint8), 8, 64).tolist(), len(raw)]
        table.ids([raw[a:b] for a, b in zip(at, at[1:])])
    assert table.hits > 1.7 * table.misses
