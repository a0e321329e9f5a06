"""Template residue, filler, error pages and notices that scripts are required.

Character n-gram models of filler, of error notices and of natural prose are compared
along a text: each character adds the logarithm of the ratio of its probabilities after
the characters before it. Within each line and sentence the window of highest sum is
localised; it is residue if the sum passes a threshold and the window covers enough of
its line or sentence, or outweighs the rest of it, since prose that speaks of an error
page has the same words, but goes on. Unfilled placeholders are read by their shape: letters, words in capitals,
numbers and words that ask for input each become one character, and n-gram models of
these shapes are compared; there a window needs no coverage, since a placeholder stands
inside a sentence.

Residue is fitted on written examples (residue_examples). Natural prose is fitted on all
different texts of the corpus, counted in its tasks, each different passage once, without the passages that the joint frequencies of their 4-grams already give to
residue: a page that many texts repeat is no evidence of prose. A passage that more than REPEATS texts hold must be clear of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hemiciclo.llm import residue_examples as examples
from hemiciclo.llm.tables import buffered

CHUNK = 1 << 16  # counters that are summed up together
THRESHOLD = 16.0
SLOT = 0.6  # of the threshold: what a placeholder must reach, whose few signs each say more
REPEATS, REPEATED_GAIN = 2, -0.5  # a passage of more texts is prose only where its 4-grams speak against residue
SHARE, STRONG = 0.55, 60.0  # a window of less than that share of its line or sentence, whose rest outweighs it, counts from STRONG on
CLIP, SLOT_CLIP = 6.0, 9.0  # one odd character alone says little, an odd sign more
SIZES, STRENGTH = (16, 18, 20, 20, 20), 1.5  # bits of the table of each order
ORDER = len(SIZES)
BREAK = 6  # characters between texts

CUES = {w for ask in examples.ASKS for w in re.findall(r"[^\W_]+", ask.replace("%s", ""))} - {"de", "a", "in", "with", "your", "su", "seu", "nombre", "por"}
VOIDS = {w for mark in examples.MARKS for w in re.findall(r"[^\W\d_]{2,}", mark.lower())} - {"object", "ref", "value", "name", "div", "no", "firma", "function", "native", "code"}
TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|_{4,}|([^\w\s])\1{2,}|.", re.DOTALL)
SIGNS = re.compile(r"[\[\]{}<>#@«»_~|$^]")
OPENED, STARRED = re.compile(r"\.\.\. ?\("), re.compile(r"/\*|\*\w")
PERCENT = re.compile(r"%(?:(?<![\d ]%)|(?=[\w(]))")
ASKED = re.compile(r"[(:] ?(?:" + "|".join(sorted(CUES)) + r")\b", re.I)
VOID_PART = re.compile("|".join(sorted(VOIDS)))
VOID = re.compile(r"\b(?:" + "|".join(sorted(VOIDS)) + r")\b")
ROMAN = re.compile(r"[IVXLCDM]{1,3}")
PLAIN = np.array([ord(c) for c in "aA0 .,;:"], dtype=np.uint64)
PASSAGE = re.compile(r"[.!?…\n](?:(?<=\n)|(?=\s))")
VARIES = re.compile(r"[\d_/@]|\.\w")  # in numbers, codes, addresses and file names


def characters(texts: list[str]) -> np.ndarray:
    """The characters of the texts in lower case, digits as one, with BREAK zeros before each."""
    gap = "\0" * BREAK
    codes = np.frombuffer((gap + gap.join(texts)).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 49) & (codes <= 57)] = 48
    return codes


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the place in its table of the n-gram that ends at each character."""
    out, base = [], codes * np.uint64(0x9E3779B97F4A7C15)
    h, stirred = base.copy(), base ^ (base >> np.uint64(29))
    for n in range(1, ORDER + 1):
        if n > 1:
            h[n - 1 :] += stirred[: 1 - n] * np.uint64((2 * n + 1) * 0xBF58476D1CE4E5B9 % (1 << 64))
        at = h >> np.uint64(31)
        at ^= h
        at >>= np.uint64(8)
        at &= np.uint64((1 << SIZES[n - 1]) - 1)
        out.append(at.view(np.int64))
    return out


class Model:
    """Counts of n-grams up to ORDER; a longer context is trusted as far as it was seen."""

    logs: np.ndarray | None = None  # log_frequencies() of all 4-grams, made where they are used, not shipped

    def __init__(self, texts: list[str], once: bool = True):
        self.counts = [np.zeros(1 << bits, dtype=np.float32) for bits in SIZES]
        for start in range(0, len(texts), 2000):
            codes = characters(texts[start : start + 2000])
            for n, at in enumerate(grams(codes)):
                self.counts[n] += np.bincount(at, minlength=1 << SIZES[n]).astype(np.float32)
        if not once:  # what stands once may be the very text that is judged
            for n in range(2, ORDER):
                self.counts[n] = np.maximum(self.counts[n] - 1, 0)
        self.total = float(self.counts[0].sum())

    def __getstate__(self) -> dict:
        """Only the n-grams that were seen are shipped."""
        return {"total": self.total, "seen": [(at := np.flatnonzero(c).astype(np.int32), c[at]) for c in self.counts]}

    def __setstate__(self, state: dict) -> None:
        self.total, self.counts = state["total"], [np.zeros(1 << bits, dtype=np.float32) for bits in SIZES]
        for c, (at, values) in zip(self.counts, state["seen"]):
            c[at] = values

    def log_probabilities(self, places: list[np.ndarray]) -> np.ndarray:
        p = (self.counts[0][places[0]] + np.float32(0.05)) / np.float32(self.total + 0.05 * 5000)
        for n in range(1, ORDER):
            context = np.zeros_like(p)
            seen = self.counts[n - 1][places[n - 1]]
            context[1:] = seen[:-1]
            p = (self.counts[n][places[n]] + np.float32(STRENGTH) * p) / (np.maximum(context, self.counts[n][places[n]]) + np.float32(STRENGTH))
        return np.log(p)

    def log_frequencies(self, fourth: np.ndarray) -> np.ndarray:
        """Of the 4-gram that ends at each character, whatever stands before: a few strays change it little."""
        if self.logs is None:
            self.logs = np.log((self.counts[3] + np.float32(0.5)) / np.float32(self.total + 1))
        return self.logs[fourth]


def ratio(places: list[np.ndarray], residue: Model, base: np.ndarray, gaps: np.ndarray, clip: float = CLIP) -> np.ndarray:
    """Log-likelihood ratio of each character; 0 between texts."""
    llr = np.clip((residue.log_probabilities(places) - base).astype(np.float64), -clip, clip)
    strange = residue.counts[3][places[3]] == 0  # what residue doesn't know either is no sign of it
    llr[strange] = np.minimum(llr[strange], 0)
    llr[gaps] = 0
    return llr


def unit_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where lines begin, and where lines or sentences do; the gap before a text belongs to no line."""
    n = len(codes)
    before = np.concatenate([[np.uint64(0)], codes[:-1]])
    earlier = np.concatenate([[np.uint64(0)] * 2, codes[:-2]])[:n]
    line = (before == 10) | ((before == 0) != (codes == 0)) | (before == 13)
    line[0] = True
    ends = (earlier == ord(".")) | (earlier == ord("!")) | (earlier == ord("?")) | (earlier == ord("…"))
    blank = (before == 32) | (before == 9)
    return np.flatnonzero(line), np.flatnonzero(line | (ends & blank))


def rises(llr: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit the highest sum of a window; how far the sum rose at each character, and the sums before each."""
    total = np.cumsum(llr)
    # a unit's sums lie far below those before it, so that no window crosses its start
    drop = np.zeros(len(llr))
    drop[starts] = 1e6
    before = total - llr - np.cumsum(drop)
    rise = before + llr - np.minimum.accumulate(before)
    return np.maximum.reduceat(rise, starts), rise, before


def windows(llr: np.ndarray, starts: np.ndarray, threshold: float) -> list[tuple[int, int, float, float, float]]:
    """The window of highest sum of each unit that reaches threshold: begin, end, sum, its share of the unit, sum of the unit."""
    if not len(llr):
        return []
    best, rise, before = rises(llr, starts)
    ends = np.append(starts[1:], len(llr))
    out = []
    for i in np.flatnonzero(best >= threshold):
        a, z = int(starts[i]), int(ends[i])
        peak = a + int(rise[a:z].argmax())
        begin = a + int(before[a : peak + 1].argmin())
        out.append((begin, peak + 1, float(rise[peak]), (peak + 1 - begin) / (z - a), float(llr[a:z].sum())))
    return out


def probed(text: str) -> bool:
    """Whether a text may hold a placeholder at all."""
    if SIGNS.search(text) or "--" in text or "…(" in text or ("%" in text and PERCENT.search(text)) or (("(" in text or ":" in text) and ASKED.search(text)):
        return True
    if ("..." in text and OPENED.search(text)) or ("*" in text and STARRED.search(text)):
        return True
    low = text.lower()
    return VOID_PART.search(low) is not None and VOID.search(low) is not None


def shaped(passage: str) -> tuple[str, list[int]]:
    """A passage as a string of token kinds, with the place of each."""
    out, at = [], []
    for m in TOKEN.finditer(passage):
        t = m[0]
        c = t[0]
        if c.isspace():
            s = " "
        elif c.isdecimal():
            s = "0"
        elif c.isalpha():
            low = t.lower()
            s = "c" if low in CUES else "u" if low in VOIDS and not ROMAN.fullmatch(t) else "A" if len(t) > 1 and t.isupper() else "a"
        else:
            s = t[:4] if c == "_" else t[:3]
        out.append(s)
        at += [m.start()] * len(s)
    return "".join(out), at


class Judge:
    """The models: filler and notices against prose, placeholders against natural shapes."""

    def __init__(self, kinds: list[Model], prose: Model, slots: Model, natural: Model):
        self.kinds, self.prose, self.slots, self.natural = kinds, prose, slots, natural
        self.side_by_side: list[np.ndarray] | None = None  # made where it is used, not shipped

    def ratios(self, places: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
        """For each kind the log-likelihood ratio of each character to prose; all models' counts are fetched at once."""
        models = [*self.kinds, self.prose]
        if self.side_by_side is None:
            self.side_by_side = [np.stack([m.counts[n] for m in models], axis=1) for n in range(ORDER)]
        seen = self.side_by_side[0][places[0]]
        p = (seen + np.float32(0.05)) / (np.array([m.total for m in models], dtype=np.float32) + np.float32(0.05 * 5000))
        context = np.zeros_like(p)
        for n in range(1, ORDER):
            here = self.side_by_side[n].take(places[n], axis=0)
            np.maximum(seen[:-1], here[1:], out=context[1:])
            context[0] = here[0]
            context += np.float32(STRENGTH)
            p *= np.float32(STRENGTH)
            p += here
            p /= context
            if n == 3:
                strange = here == 0
            seen = here
        logs = np.log(p, out=p)
        out = []
        for k in range(len(self.kinds)):
            llr = np.clip(logs[:, k] - logs[:, -1], -CLIP, CLIP).astype(np.float64)
            # what residue doesn't know either is no sign of it, nor is a number alone
            np.minimum(llr, 0, out=llr, where=strange[:, k] | (codes == 48))
            llr[codes == 0] = 0
            out.append(llr)
        return out

    def shape_windows(self, passages: list[str], threshold: float) -> list[list[tuple[int, int, float]]]:
        """For each passage its windows of unfilled placeholders, in characters of the passage."""
        shapes = [shaped(p) for p in passages]
        return [[(at[begin], at[end] if end < len(at) else len(p), total) for begin, end, total in found] for (_, at), p, found in zip(shapes, passages, self.windows_of(shapes, threshold))]

    def windows_of(self, shapes: list[tuple[str, list[int]]], threshold: float) -> list[list[tuple[int, int, float]]]:
        """For each shape its windows, in token kinds."""
        codes = cased([s for s, _ in shapes])
        places, gaps = grams(codes), codes == 0
        llr = ratio(places, self.slots, self.natural.log_probabilities(places), gaps, SLOT_CLIP)
        plain = np.isin(codes, PLAIN)  # words, numbers and blanks alone are no sign of a slot
        alone = plain & np.concatenate([[True], plain[:-1]]) & np.concatenate([[True] * 2, plain[:-2]])[: len(plain)]
        llr[alone] = np.minimum(llr[alone], 0)
        first, out = BREAK, []
        for s, _ in shapes:
            part = llr[first : first + len(s)]
            out.append([(begin, end, total) for begin, end, total, _, _ in windows(part, np.array([0]), threshold)])
            first += len(s) + BREAK
        return out

    def scores(self, texts: list[str], threshold: float, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the highest sum of a window that counts, and the share of characters in such windows."""
        codes = characters(texts)
        sizes = np.array([len(t.lower()) for t in texts], dtype=np.int64)
        first = np.cumsum(sizes + BREAK) - sizes
        marked: list[list[tuple[int, int]]] = [[] for _ in texts]
        best = np.zeros(len(texts))
        lines, units = unit_starts(codes)
        ends = np.append(lines[1:], len(codes))
        for llr in self.ratios(grams(codes), codes):
            # a sentence's window lies in its line's, so only lines that reach the threshold are looked at closer
            for j in np.flatnonzero(rises(llr, lines)[0] >= threshold):
                a, z = int(lines[j]), int(ends[j])
                own = units[np.searchsorted(units, a) : np.searchsorted(units, z)] - a
                for starts in (own[:1], own) if len(own) > 1 else (own,):
                    for begin, end, total, part, unit in windows(llr[a:z], starts, threshold):
                        if part >= share or unit >= 0 or total >= STRONG:
                            i = int(np.searchsorted(first, a + begin, side="right")) - 1
                            best[i] = max(best[i], total)
                            marked[i].append((a + begin - int(first[i]), a + end - int(first[i])))
        asked = [(i, m) for i, t in enumerate(texts) if probed(t) for m in passages(t) if probed(m[1])]
        for (i, (start, _)), found in zip(asked, self.shape_windows([m[1] for _, m in asked], SLOT * threshold)):
            for begin, end, total in found:
                best[i] = max(best[i], total / SLOT)
                marked[i].append((start + begin, start + end))
        coverage = np.zeros(len(texts))
        for i, spans in enumerate(marked):
            if spans:
                on = np.zeros(max(int(sizes[i]), len(texts[i])), dtype=bool)
                for a, z in spans:
                    on[a:z] = True
                coverage[i] = on.mean()
        return best, coverage


def cased(shapes: list[str]) -> np.ndarray:
    """characters() of shapes, where A and a differ."""
    gap = "\0" * BREAK
    return np.frombuffer((gap + gap.join(shapes)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def passages(text: str) -> Iterator[tuple[int, str]]:
    """The lines and sentences of a text with their places."""
    start = 0
    for m in PASSAGE.finditer(text):
        yield start, text[start : m.end()]
        start = m.end()
    if start < len(text):
        yield start, text[start:]


def forms_of(text: str) -> dict[str, str]:
    """The different lines and sentences of a text by form."""
    own: dict[str, str] = {}
    for _, p in passages(text):
        words = p.lower().split()
        if VARIES.search(p):  # else none of its words does
            words = [w if w.isalpha() or not VARIES.search(w) else "0" for w in words]
        form = " ".join(words)
        if form:
            own.setdefault(form, p)
    return own


def different_passages(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The different lines and sentences of the texts, and how many texts hold each; numbers, codes and addresses make no difference."""
    kept: dict[str, str] = {}
    holders: Counter[str] = Counter()
    for t in texts:
        own = forms_of(t)
        holders.update(own.keys())
        kept |= {form: p for form, p in own.items() if form not in kept}
    return list(kept.values()), np.array([holders[form] for form in kept], dtype=np.int64)


class ShapeModel(Model):
    """A model of shapes, whose letters keep their case."""

    def __init__(self, shapes: list[str]):
        self.counts = [np.bincount(at, minlength=1 << bits).astype(np.float32) for at, bits in zip(grams(cased(shapes)), SIZES)]
        self.total = float(self.counts[0].sum())


@lru_cache(maxsize=8)
def written(without: frozenset[str] = frozenset()) -> tuple[Model, Model, Model, Model]:
    """The models of filler, notices, placeholders and natural shapes from written examples, `without` some kinds."""
    filler = Model(examples.lines(examples.FILLER, 40, 5, without))
    notices = Model(examples.lines(examples.NOTICES, 40, 6, without))
    return filler, notices, ShapeModel([shaped(x)[0] for x in examples.placeholders(7, without)]), ShapeModel([shaped(x)[0] for x in examples.naturals(8)])


def doubts(codes: np.ndarray, fourth: np.ndarray, sizes: np.ndarray, repeated: np.ndarray, mixed: Model, kinds: tuple[Model, ...]) -> np.ndarray:
    """Of passages of those sizes, whose characters and 4-grams these are: doubted()."""
    base = mixed.log_frequencies(fourth)
    first = np.cumsum(sizes + BREAK) - sizes
    doubt = np.zeros(len(sizes), dtype=bool)
    for kind in kinds:
        gain = kind.log_frequencies(fourth) - base
        gain[codes == 0] = 0
        total = np.concatenate([[0], np.cumsum(gain)])
        # what many texts repeat is a heading, a formula or a template: less speaks for prose
        doubt |= (total[first + sizes] - total[first]) > np.where(repeated, REPEATED_GAIN * sizes, 0.4 * sizes + 4)
    return doubt


def doubted(different: list[str], often: np.ndarray, mixed: Model, without: frozenset[str] = frozenset()) -> np.ndarray:
    """Which passages the joint frequencies of their 4-grams give to residue; those that many texts repeat must be clear of it."""
    out = []
    for start in range(0, len(different), 20_000):
        part, repeated = different[start : start + 20_000], often[start : start + 20_000]
        codes = characters(part)
        out.append(doubts(codes, grams(codes)[3], np.array([len(p.lower()) for p in part]), repeated, mixed, written(without)[:2]))
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def fitted(sample: list[str], without: frozenset[str] = frozenset()) -> Judge:
    """The judge of a corpus of which sample are some different texts."""
    filler, notices, slots, natural = written(without)
    different, holders = different_passages(sample)
    if not different:
        different = list(examples.naturals(8))
        holders = np.ones(len(different), dtype=np.int64)
    mixed = Model(different)
    prose = [p for p, d in zip(different, doubted(different, holders > REPEATS, mixed, without)) if not d]
    judge = Judge([filler, notices], Model(prose, once=False), slots, natural)
    # shapes of the corpus's own, without what the written examples give to placeholders
    judge.natural = ShapeModel([*(shaped(x)[0] for x in examples.naturals(8)), *clean_of_slots(prose, judge)])
    return judge


def clean_of_slots(prose: list[str], judge: Judge) -> list[str]:
    """The shapes of the passages that may hold a placeholder and that the written examples don't give to one."""
    asked = [shaped(p) for p in prose if probed(p)]
    return [shape for (shape, _), found in zip(asked, judge.windows_of(asked, SLOT * THRESHOLD / 2)) if not found] if asked else []


def chunked(kind: int, tables: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
    """The counters of a task that aren't all zero, in chunks: kind, order, number of the chunk, counts."""
    for n, table in enumerate(tables):
        for at in range(0, len(table), CHUNK):
            if (part := table[at : at + CHUNK]).any():
                yield kind, n, at // CHUNK, part.tobytes()


def counted_in_tasks(passages_: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, int, bytes]]]) -> dict[int, list[np.ndarray]]:
    """By kind the tables of counts of all tasks, added; the driver gets one row of each chunk and adding task."""
    schema = "kind int, size int, chunk int, counts binary"

    def packed(rows: Iterable[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.binary() if i == 3 else pa.int32()) for i, x in enumerate(row)], names=["kind", "size", "chunk", "counts"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["kind"], r["size"], r["chunk"])
                part = np.frombuffer(r["counts"], dtype=np.int64)
                sums[at] = sums[at] + part if at in sums else part
        return packed((*at, x.tobytes()) for at, x in sums.items())

    out: dict[int, list[np.ndarray]] = {}
    for r in passages_.mapInArrow(lambda batches: packed(count(batches)), schema).repartition("kind", "size", "chunk").mapInArrow(added, schema).toLocalIterator():
        tables = out.setdefault(r["kind"], [np.zeros(1 << bits, dtype=np.int64) for bits in SIZES])
        part = np.frombuffer(r["counts"], dtype=np.int64)
        tables[r["size"]][r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] += part
    return out


def model_of(tables: list[np.ndarray], kind: type[Model] = Model) -> Model:
    model = kind([])
    model.counts, model.total = [t.astype(np.float32) for t in tables], float(tables[0].sum())
    return model


def add_counts(tables: list[np.ndarray], codes: np.ndarray) -> None:
    add_places(tables, grams(codes))


def add_places(tables: list[np.ndarray], places: list[np.ndarray]) -> None:
    for table, at in zip(tables, places):
        table += np.bincount(at, minlength=len(table))


def count_prose(own: list[str], often: np.ndarray, judge: Judge, kinds: tuple[Model, ...], prose: list[np.ndarray], shapes: list[np.ndarray]) -> None:
    """Adds the n-grams of the passages that aren't doubted to prose, and those of their shapes to shapes; each passage is read once."""
    codes, sizes = characters(own), np.array([len(p.lower()) for p in own])
    places = grams(codes)
    clear = ~doubts(codes, places[3], sizes, often, judge.prose, kinds)
    add_places(prose, places if clear.all() else [at[np.repeat(clear, sizes + BREAK)] for at in places])
    if clean := clean_of_slots([p for p, c in zip(own, clear) if c], judge):
        add_counts(shapes, cased(clean))


def fitted_on_all(df: DataFrame, text: str) -> Judge:
    """fitted() on all different texts of df, counted in its tasks.

    Different passages are made once and read twice: for the joint frequencies, then for the
    models of prose and of its shapes.
    """
    different = df.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text)).agg(F.min(text).alias("t")).select("t")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in buffered(batches, 1024, 1 << 20):
            forms, own = [], []
            for t in part["t"].to_pylist():
                found = forms_of(t)
                forms += found.keys()
                own += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(own, pa.string())], names=["form", "p"])

    rows = different.mapInArrow(split, "form string, p string").select(F.xxhash64("form").alias("h"), "p").groupBy("h").agg(F.min("p").alias("p"), (F.count("*") > REPEATS).alias("often")).select("p", "often")
    rows = rows.persist(StorageLevel.DISK_ONLY)
    batches_of = lambda batches: ((b["p"].to_pylist(), b["often"].to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        tables = [np.zeros(1 << bits, dtype=np.int64) for bits in SIZES]
        for own, _ in batches_of(batches):
            add_counts(tables, characters(own))
        return chunked(0, tables)

    try:
        mixed = counted_in_tasks(rows, joint)
        if not mixed:
            return fitted([])
        shared = df.sparkSession.sparkContext.broadcast((model_of(mixed[0]), *written()))  # written once, not by each worker

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
            prose, shapes = ([np.zeros(1 << bits, dtype=np.int64) for bits in SIZES] for _ in range(2))
            joint_model, filler, notices, *of_shapes = shared.value
            judge = Judge([], joint_model, *of_shapes)  # compares with the joint frequencies
            for own, often in batches_of(batches):
                count_prose(own, often, judge, (filler, notices), prose, shapes)
            yield from chunked(1, prose)
            yield from chunked(2, shapes)

        counts = counted_in_tasks(rows, kept)
    finally:
        rows.unpersist()
    zeros = [np.zeros(1 << bits, dtype=np.int64) for bits in SIZES]
    prose, shapes = model_of(counts.get(1, zeros)), counts.get(2, zeros)
    for n in range(2, ORDER):  # what stands once may be the very text that is judged
        prose.counts[n] = np.maximum(prose.counts[n] - 1, 0)
    add_counts(shapes, cased([shaped(x)[0] for x in examples.naturals(8)]))
    filler, notices, slots, _ = written()
    return Judge([filler, notices], prose, slots, model_of(shapes, ShapeModel))


def distinct_sample(df: DataFrame, text: str, n: int) -> list[str]:
    """About n different texts, the same ones at every run: those of smallest hash. All of them, if they aren't more.

    Only hashes are shuffled for the count, and the drawn texts to take one of each.
    """
    hashed = df.select(F.pmod(F.xxhash64(text), F.lit(1 << 40)).alias("h"), text)
    total = hashed.select("h").distinct().count()
    cutoff = 1 << 40 if total <= n else int((1 << 40) * min(1.0, (1.2 * n + 50) / total))
    drawn = hashed.where(F.col("h") < cutoff).groupBy("h").agg(F.min(text).alias(text)).collect()  # about 1.2 n rows
    return [r[text] for r in sorted(drawn, key=lambda r: r["h"])[:n]]


def residue_scores(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, score and coverage of each text: the highest log-likelihood ratio of a window that
    counts as residue, and the share of characters in such windows.

    Null, empty and blank texts score 0. Every row gives a row; texts are read whole; extra
    columns aren't read. The model of prose is fitted on all different texts, each passage once;
    with none, on the written examples alone.
    """
    rows = df.select(key, text)
    judge = df.sparkSession.sparkContext.broadcast(fitted_on_all(rows, text))  # tables of SIZES counts, whatever the input
    schema = StructType([df.schema[key], StructField("score", DoubleType()), StructField("coverage", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = judge.value
        for part in buffered(batches, 4096, 1 << 18):
            texts = part[text].fill_null("").to_pylist()
            score, coverage = models.scores([t.replace("\0", " ") if t.strip() else "" for t in texts], threshold)
            keys = part[key].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys, pa.array(score), pa.array(coverage)], names=[key, "score", "coverage"])

    return rows.mapInArrow(run, schema)


def with_residue(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least_coverage: float = 0.0, **options) -> DataFrame:
    """key of the texts to exclude: those with a window of at least threshold and that share of the text in such windows."""
    return residue_scores(df, key, text, threshold, **options).where((F.col("score") >= threshold) & (F.col("coverage") >= least_coverage)).select(key)
