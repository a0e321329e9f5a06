"""Free-entered values mapped to the entries of a reference list.

The entries stand in a trie of their letters, each with alias paths that lead to
the same entry: its code, its name without linking words, without its first word,
or with the first word last. Which entry a path leads to is settled over the whole
reference, before it is cut into blocks: a name stands before an alias, and an alias that
two entries share is none. A typed
value is read in a few ways (whole, without brackets, parts at dashes ...), and
each reading is searched in the trie with a Levenshtein automaton: a band of
states is moved along the letters of the trie and cut off where no state is
within the distance that the reading's length allows. Words cut short by a full
stop follow an alias path of their own, word by word. What the blocks find is united
before it is decided, so the answer doesn't depend on their size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from hemiciclo.llm.tables import checkpointed

# Digits typed for letters, linking words, and words that stand around a name.
DIGITS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
LINKING = {"por", "un", "una", "y", "e", "de", "del", "la", "el", "los", "las"}
AROUND = re.compile(
    r"^(?:(?:el|la|los|las|partido politico|p\.? ?p\.?|pp|organizacion(?: politica)?|agrup\.? ?pol\.?|agrupacion politica|movimiento politico|lista|org\.? ?pol\.?)[ :]+)+(?=\S)|(?: (?:20\d\d|lista nacional|2da vuelta|inscrito|\d+))+$"
)
PATHS = 100_000


def allowed(letters: int) -> int:
    """The distance that a reading of so many letters may have to an entry."""
    return 0 if letters <= 5 else 1 if letters <= 9 else 2 if letters <= 14 else 3


def folded(text: str) -> str:
    """Lower case without accents; text decoded with the wrong table is decoded again."""
    if "Ã" in text or "Â" in text:
        for table in ("cp1252", "latin-1"):
            try:
                text = text.encode(table).decode("utf-8")
                break
            except UnicodeError:
                pass
    plain = unicodedata.normalize("NFKD", text)
    return re.sub(r"\s+", " ", "".join(c for c in plain if not unicodedata.combining(c)).lower()).strip()


def letters_of(text: str) -> str:
    """The letters of a folded text, with digits only inside words that have letters."""
    words = re.findall(r"[^\W_]+|[@$]+", text)
    return "".join(w for w in words if not w.isdigit())


Path = tuple[str, str, list]  # kind (letters, words or code), the path, keys of the entries


def paths_of(key: object, name: str, code: str | None) -> Iterator[tuple[str, str, bool]]:
    """The alias paths of an entry: kind, path, and whether it is the name itself."""
    words = re.findall(r"[^\W_]+", folded(name))
    if words:
        yield "letters", "".join(words), True
        kept = [w for w in words if w not in LINKING]
        first, rest, kept_rest = words[0], words[1:], kept[1:]
        for alias in (words, kept, [*rest, first], [*kept_rest, first], rest if len(kept_rest) > 1 else [], kept_rest if len(kept_rest) > 1 else []):
            if alias:
                yield "letters", "".join(alias), False
        for alias in {tuple(words), tuple(kept)}:
            if alias:
                yield "words", " ".join(alias), True
        if code and code.strip() and letters_of(folded(code)):
            yield "code", letters_of(folded(code)), True


class Names:
    """The trie of paths that are settled."""

    def __init__(self, paths: list[Path]):
        self.words: dict = {}
        self.exact: dict[str, set] = {}
        self.trie: dict = {}
        for kind, path, keys in paths:
            if kind == "code":
                self.exact.setdefault(path, set()).update(keys)
                continue
            node = self.words if kind == "words" else self.trie
            for step in path.split(" ") if kind == "words" else path:
                node = node.setdefault(step, {})
            node.setdefault("", set()).update(keys)

    @classmethod
    def of(cls, entries: list[tuple[object, str, str | None]]) -> Names:
        """Of a reference that is read as a whole."""
        heads: dict[tuple[str, str], tuple[set, set]] = {}
        for key, name, code in entries:
            for kind, path, own in paths_of(key, name, code):
                heads.setdefault((kind, path), (set(), set()))[not own].add(key)
        return cls([(kind, path, list(names or aliases)) for (kind, path), (names, aliases) in heads.items() if names or len(aliases) == 1])

    def near(self, letters: str, limit: int) -> dict[object, int]:
        """All entries within limit edits (a swap of neighbours is one), with their distance."""
        n, found = len(letters), {}
        far = limit + 1
        # node, its depth, its row, the row above it and the letter that led to it: a stack, since names may be long
        stack = [(self.trie, 0, [j if j <= limit else far for j in range(n + 1)], None, "")]
        while stack:
            node, depth, before, earlier, came = stack.pop()
            d = depth + 1
            for c, child in node.items():
                if c == "":
                    if before[n] <= limit:
                        for key in child:
                            found[key] = min(found.get(key, far), before[n])
                    continue
                row = [far] * (n + 1)
                least = far
                if d <= limit:
                    row[0] = least = d
                for j in range(max(1, d - limit), min(n, d + limit) + 1):
                    typed = letters[j - 1]
                    cost = before[j - 1] + (typed != c and c not in DIGITS.get(typed, ""))
                    if before[j] + 1 < cost:
                        cost = before[j] + 1
                    if row[j - 1] + 1 < cost:
                        cost = row[j - 1] + 1
                    if earlier is not None and j > 1 and typed == came and letters[j - 2] == c and earlier[j - 2] + 1 < cost:
                        cost = earlier[j - 2] + 1
                    row[j] = cost
                    if cost < least:
                        least = cost
                if least <= limit:
                    stack.append((child, d, row, before, c))
        return found

    def cut_short(self, tokens: list[str]) -> dict[object, int]:
        """Entries whose words begin as the tokens that end in a full stop, and are the others."""
        nodes = [(self.words, 0)]
        for t in tokens:
            after = []
            for node, errors in nodes:
                for word, child in node.items():
                    if word == "":
                        continue
                    if t.endswith("."):
                        if len(t) > 2 and word.startswith(t[:-1]):
                            after.append((child, errors))
                    elif word == t:
                        after.append((child, errors))
                    elif errors == 0 and len(t) > 5 and edits(word, t) == 1:
                        after.append((child, 1))
            nodes = after
        found: dict[object, int] = {}
        for node, errors in nodes:
            for key in node.get("", ()):
                found[key] = min(errors, found.get(key, 9))
        return found

    def hits(self, typed: str, around: re.Pattern) -> Iterator[tuple[int, int, object, int]]:
        """What these paths find: number of the reading, how it was found (0 code, 1 cut short, 2 near), key and distance.

        What an exact hit of this block already rules out for any block isn't looked up.
        """
        spread = re.sub(r"(?<=[a-zñáéíóúü])(?=[A-ZÑÁÉÍÓÚ])", " ", typed) if re.fullmatch(r"\W*\w+\W*", typed) else typed
        for number, reading in enumerate(readings(folded(spread), around)):
            tokens = re.findall(r"[^\W_]+\.?", re.sub(r"\.{2,}", " ", reading))
            letters = letters_of(reading)
            if not letters:
                continue
            how, here = 0, {k: 0 for k in self.exact.get(letters, ())} if len(letters) <= 6 else {}
            if not here and any(t.endswith(".") for t in tokens[:-1] or tokens):
                how, here = 1, self.cut_short(tokens)
            if not here:
                how, here = 2, self.near(letters, allowed(len(letters)))
            yield from ((number, how, k, d) for k, d in here.items())
            if 0 in here.values():
                break


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def readings(text: str, around: re.Pattern = AROUND) -> list[str]:
    """The ways to read a folded text as a name, the whole first."""
    out = [text, around.sub("", text)]
    bare = re.sub(r"[(\[{].*?[)\]}]", " ", text)
    bare = re.sub(r"\s+", " ", bare).strip(" *'\"«»“”#.")
    out += [bare, around.sub("", bare)]
    parts = [p.strip() for p in re.split(r"\s[-–—/|]\s|[:;|/]", bare) if p.strip()]
    if len(parts) > 1:
        out += [around.sub("", p) for p in sorted(parts, key=len, reverse=True)]
    out += re.findall(r"[(\[](.*?)[)\]]", text)
    return list(dict.fromkeys(x for x in out if x))


def settled(reference: DataFrame, key: str, name: str, code: str | None) -> DataFrame:
    """kind, path and keys of all paths of a reference that lead to an entry."""
    entries = reference.select(F.col(key).alias("key"), F.col(name).cast("string").alias("name"), (F.col(code).cast("string") if code else F.lit(None).cast("string")).alias("code")).where("key IS NOT NULL AND name IS NOT NULL")
    kind = entries.schema["key"].dataType

    def spell(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *path) for k, n, c in zip(*(b.column(i).to_pylist() for i in range(3))) for path in paths_of(k, n, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())], names=["key", "kind", "path", "own"])

    schema = StructType([StructField("key", kind), StructField("kind", StringType()), StructField("path", StringType()), StructField("own", BooleanType())])
    heads = entries.mapInArrow(spell, schema).groupBy("kind", "path").agg(F.sort_array(F.collect_set(F.when(F.col("own"), F.col("key")))).alias("names"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return heads.select("kind", "path", F.when(F.size("names") > 0, F.col("names")).when(F.col("lo") == F.col("hi"), F.array("lo")).alias("keys")).where("keys IS NOT NULL")


def matched(values: DataFrame, value: str, reference: DataFrame, key: str, name: str, code: str | None = None, block: int = PATHS, around: re.Pattern = AROUND) -> DataFrame:
    """All entries near each distinct non-blank value: columns value, key and distance.

    Values without an entry within the allowed distance give no row. The settled paths go
    to the tasks in blocks of at most about `block`, one pass for each; of a value's
    readings, in their order, those behind the first that fits exactly don't count, and of
    one reading a code stands before words cut short and these before near ones, whatever
    block found them. Entries with a null key or name take no part. Other columns aren't read.
    around is what may stand before or behind a name.
    """
    paths = checkpointed(settled(reference, key, name, code))
    blocks = max(1, -(-paths.count() // block))
    distinct = values.select(F.col(value).cast("string").alias(value)).where(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")) != "").distinct()
    # few bytes, much work: so many tasks whatever their size
    distinct = distinct.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = reference.schema[key].dataType
    schema = StructType([StructField(value, StringType()), StructField("reading", IntegerType()), StructField("how", IntegerType()), StructField(key, kind), StructField("distance", IntegerType())])
    arrow = to_arrow_type(kind)
    out: DataFrame | None = None
    for b in range(blocks):
        rows = [(r["kind"], r["path"], list(r["keys"])) for r in paths.where(F.pmod(F.xxhash64("path"), F.lit(blocks)) == b).collect()]

        def run(batches, rows=rows) -> Iterator[pa.RecordBatch]:
            names = Names(rows)
            for batch in batches:
                hits = [(v, *h) for v in batch.column(0).to_pylist() for h in names.hits(v, around)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), *(pa.array([h[i] for h in hits], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, arrow), (4, pa.int32())))], names=schema.names)

        found = distinct.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    first = F.min(F.when(F.col("distance") == 0, F.col("reading"))).over(Window.partitionBy(value))
    how = F.min("how").over(Window.partitionBy(value, "reading"))
    # a value's rows are the entries near it
    kept = out.withColumn("first", first).where("first IS NULL OR reading <= first").withColumn("least", how).where("how = least")
    return kept.groupBy(value, key).agg(F.min("distance").alias("distance"))


def canonical(df: DataFrame, row: str, value: str, reference: DataFrame, key: str, name: str, code: str | None = None, unmatched: int = -1, block: int = PATHS, around: re.Pattern = AROUND) -> DataFrame:
    """row and key of the entry meant by value, or `unmatched`, for each row whose value is
    not null, not blank and not exactly a name of the reference.

    The nearest entry is meant; if two are equally near, none is. Repeated rows give
    repeated rows; an empty reference leaves all unmatched.
    """
    typed = df.select(row, value).where(F.col(value).isNotNull() & (F.trim(F.regexp_replace(value, r"(?U)\s+", " ")) != ""))
    typed = typed.join(reference.select(F.col(name).alias(value)).where(F.col(value).isNotNull()).distinct(), value, "left_anti")
    near = matched(typed, value, reference, key, name, code, block, around)
    best = near.groupBy(value, "distance").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).groupBy(value).agg(F.min(F.struct("distance", "lo", "hi")).alias("best"))
    meant = best.where("best.lo = best.hi").select(value, F.col("best.lo").alias(key))
    return typed.join(meant, value, "left").select(row, F.coalesce(F.col(key), F.lit(unmatched)).alias(key))
