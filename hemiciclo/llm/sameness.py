"""One form for texts that look the same.

Each character has a quick-check property: stable characters stand for
themselves whatever surrounds them. Only segments around unstable ones (wide and
joined forms, look-alike letters, unseen characters, odd spaces and hyphens,
combining marks) are isolated, with the character before them as context,
brought to one form and spliced back into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hemiciclo.llm.tables import buffered, checkpointed

SALTS = 8
# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ԍ": "g", "ӏ": "l", "ѵ": "v", "ү": "y", "ɡ": "g", "ɑ": "a", "ı": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y", "κ": "k", "χ": "x", "τ": "t",
}
# Hyphens that look like the plain one, and unseen characters that aren't of category Cf.
HYPHENS = "‐‑﹣－"
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


@lru_cache(maxsize=1 << 16)
def plain(char: str) -> str:
    """What a single character stands for, before accents are composed."""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char in HYPHENS:
        return "-"
    kind = unicodedata.category(char)
    if kind == "Cf" or char in UNSEEN or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    tag, _, parts = unicodedata.decomposition(char).partition(" ")
    if tag in ("<wide>", "<narrow>"):
        return "".join(plain(chr(int(p, 16))) for p in parts.split())
    if tag == "<compat>":
        letters = [chr(int(p, 16)) for p in parts.split()]
        if len(letters) > 1 and all(unicodedata.category(x) in ("Lu", "Ll", "Lt") for x in letters):
            return "".join(plain(x) for x in letters)
    return char


@lru_cache(maxsize=1)
def unstable() -> tuple[re.Pattern, re.Pattern]:
    """A character that fails the quick check; runs of them, with the character before."""
    spans: list[list[int]] = []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0x9FFF or 0xAC00 <= cp < 0xD7A4:
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Cn":
            continue
        if unicodedata.normalize("NFC", "".join(map(plain, unicodedata.normalize("NFD", c)))) != c or unicodedata.combining(c) or 0x1160 <= cp < 0x1200:
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    odd = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    # a line's end after a soft hyphen shows the hyphen
    return re.compile(f"[{odd}]"), re.compile(f"[^{odd}]?[{odd}]+\n?", re.DOTALL)


def one_form(text: str | None) -> str | None:
    """text in the one form of all texts that look like it; null stays null."""
    if text is None or text.isascii():
        return text
    odd, segments = unstable()
    if not odd.search(text):
        return text

    def spliced(m: re.Match) -> str:
        segment = re.sub("­(?=[­​-‏⁠﻿]*\r?\n)", "-", m[0])
        return unicodedata.normalize("NFC", "".join(map(plain, unicodedata.normalize("NFD", segment) if not segment.isascii() else segment)))

    return segments.sub(spliced, text)


def with_one_form(df: DataFrame, key: str, text: str, name: str = "form") -> DataFrame:
    """key, text and its one form, as columns key, text and name. Null texts stay null."""
    schema = StructType([df.schema[key], df.schema[text], StructField(name, StringType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in buffered(batches, 4096, 4 << 20):
            for b in part.to_batches():
                forms = pa.array([one_form(t) for t in b.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), forms], names=[key, text, name])

    return df.select(key, text).mapInArrow(run, schema)


def spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, spelling (two hashes of the text as stored) and form (two hashes of its one form), without nulls; read once."""
    forms = with_one_form(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()), key, text, "form")
    two = lambda c: (F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(7), c))
    (s1, s2), (f1, f2) = two(text), two("form")
    return checkpointed(forms.select(F.col(key).alias("key"), s1.alias("s1"), s2.alias("s2"), f1.alias("f1"), f2.alias("f2")))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each key: key, class_key (the smallest key whose text looks the same), members_n and
    spellings_n of its class, and links_n, the members whose text is stored differently.

    One row of df for each key. Null texts and keys give no row, empty texts are a class of their
    own. Nothing is paired: counts are combined before they are shuffled, so the result has a row
    for each text whatever the size of a class; look_alikes() has the pairs.
    """
    rows = spellings(df, key, text)
    own = rows.groupBy("f1", "f2", "s1", "s2").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    forms = own.groupBy("f1", "f2").agg(F.min("least").alias("class_key"), F.sum("n").alias("members_n"), F.count("*").alias("spellings_n"))
    # a class is found from its spelling, which is joined to many rows: the side of the rows may be split, this one is small for each
    classes = own.join(forms, ["f1", "f2"]).select("f1", "f2", "s1", "s2", "class_key", "members_n", "spellings_n", (F.col("members_n") - F.col("n")).alias("links_n"))
    return rows.join(classes, ["f1", "f2", "s1", "s2"]).select(F.col("key").alias(key), "class_key", "members_n", "spellings_n", "links_n")


def look_alikes(df: DataFrame, key: str, text: str, salts: int = SALTS) -> DataFrame:
    """Pairs of keys (key_a < key_b) whose texts look the same but differ in their characters.

    One row of df for each key. Null texts take no part, empty ones equal only
    themselves. Texts stored alike give no pair. A form that a single spelling has is
    dropped before the pairs are made, so what is joined are forms with a result; a form of
    many texts is spread over `salts` tasks.
    """
    rows = spellings(df, key, text)
    several = rows.groupBy("f1", "f2").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi").select("f1", "f2")
    kept = rows.join(several, ["f1", "f2"], "left_semi")
    a = kept.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts))).alias("a")
    b = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).alias("b")
    same = (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2")) & (F.col("a.salt") == F.col("b.salt"))
    return a.join(b, same & (F.col("a.key") < F.col("b.key")) & ((F.col("a.s1") != F.col("b.s1")) | (F.col("a.s2") != F.col("b.s2")))).select(F.col("a.key").alias(f"{key}_a"), F.col("b.key").alias(f"{key}_b"))
