"""Text of scanned pages repaired into continuous paragraphs.

A text is cut into lines, and lines without line ends where a running title or a
page mark stands inside. A hidden Markov model labels each line as body, header,
page mark, break or entry (of a list or table). What is seen of a line is its form and
its layout: its length against the text's usual line, how it begins and ends, its
capitals and digits, its place in the text, and whether the lines around it read on
across it. The form alone doesn't decide: a bare number between lines that read on is a
page mark, the same number in a column of numbers is an entry. Probabilities start from
written tables and are re-estimated on a bounded sample by Viterbi training. Paragraphs
are put together from the body lines; words that a line end broke are joined, unless the
corpus writes them with their own hyphen; a word that the corpus hardly knows, but
that turns into a common word when one confusion of shapes is undone, is corrected.

Running titles are counted over the whole corpus: a line that names the plan (the end of
its document id) and, with the name left out, heads several plans. A plan gets the titles
whose surroundings of the name stand in its own texts, by a join, so a task holds only the
titles of the plans it reads.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from hemiciclo.llm.sameness import one_form
from hemiciclo.llm.tables import below_cutoff, checkpointed, sliced

SAMPLE = 3000
REACH = 20
RATIO, COMMON = 10, 5
MISREAD_ROWS = 200_000  # two short strings each

# Characters or pairs and what they are misread as.
CONFUSIONS = [("a", "ci"), ("e", "c"), ("o", "0"), ("i", "1"), ("l", "1"), ("s", "5"), ("i", "l"), ("l", "i"), ("n", "ri"), ("t", "f"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("v", "y"), ("b", "6"), ("g", "9"), ("ó", "6"), ("h", "li"), ("í", "ï"), ("á", "à"), ("é", "è"), ("ó", "ò"), ("ú", "ù"), ("q", "g"), ("z", "2"), ("ñ", "fi"), ("rn", "m"), ("cl", "d"), ("w", "vv"), ("b", "8"), ("s", "8"), ("t", "7"), ("a", "4"), ("e", "é"), ("c", "e")]
STATES = ("body", "header", "page", "break", "entry")
FORMS = ("text", "title", "mark", "bare", "blank", "heading", "label")
# how likely a state shows a form, and each kind of layout; refined by training
EMITS = {"body": (0.945, 0.002, 0.005, 0.004, 0.01, 0.02, 0.014), "header": (0.02, 0.955, 0.005, 0.005, 0.005, 0.007, 0.003), "page": (0.005, 0.005, 0.75, 0.225, 0.005, 0.005, 0.005), "break": (0.02, 0.005, 0.005, 0.005, 0.5, 0.445, 0.02), "entry": (0.3, 0.005, 0.005, 0.4, 0.01, 0.03, 0.25)}
MOVES = {"body": (0.8, 0.05, 0.06, 0.07, 0.02), "header": (0.7, 0.02, 0.13, 0.12, 0.03), "page": (0.62, 0.15, 0.02, 0.18, 0.03), "break": (0.56, 0.1, 0.14, 0.13, 0.07), "entry": (0.2, 0.03, 0.05, 0.07, 0.65)}
FIRST = (0.66, 0.1, 0.1, 0.08, 0.06)
# layout: short, middle, full line; begins small, large, with a digit or sign; ends open, with an end mark, with a comma or hyphen, with a colon;
# capitals: few, title case, all; digits: none, some, most; place: alone in the text, first, last, between; the lines around it: read on across it, don't, are short themselves
LAYOUT = {
    "length": {"body": (0.2, 0.3, 0.5), "header": (0.3, 0.4, 0.3), "page": (0.94, 0.05, 0.01), "break": (0.7, 0.2, 0.1), "entry": (0.85, 0.12, 0.03)},
    "begins": {"body": (0.6, 0.3, 0.1), "header": (0.15, 0.75, 0.1), "page": (0.3, 0.2, 0.5), "break": (0.3, 0.4, 0.3), "entry": (0.2, 0.45, 0.35)},
    "ends": {"body": (0.6, 0.2, 0.15, 0.05), "header": (0.9, 0.04, 0.04, 0.02), "page": (0.9, 0.05, 0.04, 0.01), "break": (0.85, 0.08, 0.03, 0.04), "entry": (0.6, 0.1, 0.05, 0.25)},
    "capitals": {"body": (0.85, 0.13, 0.02), "header": (0.4, 0.4, 0.2), "page": (0.8, 0.1, 0.1), "break": (0.6, 0.2, 0.2), "entry": (0.6, 0.35, 0.05)},
    "digits": {"body": (0.7, 0.28, 0.02), "header": (0.55, 0.43, 0.02), "page": (0.1, 0.3, 0.6), "break": (0.6, 0.3, 0.1), "entry": (0.35, 0.25, 0.4)},
    "place": {"body": (0.25, 0.25, 0.2, 0.3), "header": (0.1, 0.3, 0.2, 0.4), "page": (0.1, 0.2, 0.3, 0.4), "break": (0.1, 0.2, 0.2, 0.5), "entry": (0.1, 0.2, 0.2, 0.5)},
    "around": {"body": (0.3, 0.5, 0.2), "header": (0.5, 0.4, 0.1), "page": (0.5, 0.42, 0.08), "break": (0.3, 0.5, 0.2), "entry": (0.05, 0.25, 0.7)},
}
KINDS = [len(v["body"]) for v in LAYOUT.values()]
LAYOUT_WEIGHT = 0.5  # kinds of layout depend on each other, so each says less than alone

HYPHEN = "-‐‑­¬"
MARK = re.compile(r"^(?:p[áa]g(?:ina)?\.? ?\d{1,4}(?: ?(?:de|/) ?\d{0,4})?|\d{1,4} ?/ ?\d{1,4}|[-—–] ?\d{1,4} ?[-—–]|\[\d{1,4}\])$", re.I)
BARE = re.compile(r"^(?:\d{1,3}|(?=[ivxlc])c{0,3}(?:x[lc]|l?x{0,3})(?:i[xv]|v?i{0,3}))$")
INSIDE = re.compile(r"(?<![\w(])(?:p[áa]gina \d{1,4} de \d{1,4}|p[áa]g\. ?\d{1,4} ?/(?: ?\d{1,4}(?!\d))?|[-—–] \d{1,4} [-—–])(?= |$)|(?<=[^\W_] )(?!(?:vi|mi|di|ci|li|il|xi) )(?-i:(?=[ivxlc]{2})c{0,3}(?:x[lc]|l?x{0,3})(?:i[xv]|v?i{0,3}))(?= )", re.I)
REFERS = re.compile(r"(?:\b(?:ver|véase|la|en|cf\.?|de)\s+)$", re.I)
HEADING = re.compile(r"^(?:\d+(?:\.\d+)+ \S.{2,60}|[A-ZÁÉÍÓÚÑ ]{4,60})$")
SOFT = "\x02"  # a soft hyphen before a space: a former line end, or unseen
BROKEN = re.compile(rf"(?<![^\W\d_])(?:([^\W\d_]++)[{HYPHEN}][ \t]*(?:\r?\n[ \t]*)+([^\W\d_]+)|([^\W\d_]++)([{HYPHEN}{SOFT}]) +([a-záéíóúüñ]+))")
NOTE = re.compile(r"\s*\((?:ver|véase|cf\.?) ", re.I)
UNUSUAL = re.compile(r"[^ \t\n\r]*[^\x00-\x7fÀ-ÿ][^ \t\n\r]*")  # a word that may not be in its one form
SPACES = re.compile("[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
LATIN = re.compile("[A-Za-zÀ-ɏＡ-Ｚａ-ｚ]")
CYRILLIC = re.compile("[\u0400-\u052f]")
CYRILLIC_WORD = re.compile("(?<![A-Za-zÀ-ɏ\u0400-\u052f])[\u0400-\u052f]{2,}(?![A-Za-zÀ-ɏ\u0400-\u052f])")
WORD = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")


def folded(char: str) -> str:
    """One letter for all that a title's letter may have become."""
    c = unicodedata.normalize("NFKD", char)[0].lower()
    return {"0": "o", "1": "i", "l": "i", "5": "s", "9": "g", "6": "b", "y": "v", "f": "t", "e": "c", "–": "-", "—": "-", "‐": "-"}.get(c[:1], c[:1])


@lru_cache(maxsize=1 << 14)
def _fold(char: str) -> str:
    return folded(char)


class Folds(dict):
    """For str.translate: the folded letter of every character, as it is asked for."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = " " if c in " \t　\xa0" else c if c == "\n" else _fold(c)
        return self[code]


FOLDS = Folds()


def folded_text(text: str) -> str:
    """text as shape() gives it, without the places."""
    return re.sub("  +", " ", text.translate(FOLDS))


def shape(text: str) -> tuple[str, list[int]]:
    """text folded, runs of spaces as one, with the place of each character."""
    out, at = [], []
    for i, c in enumerate(text):
        if c in " \t　\xa0":
            if out and out[-1] == " ":
                continue
            c = " "
        out.append(c if c == "\n" else _fold(c))
        at.append(i)
    at.append(len(text))
    return "".join(out), at


def plan_names(doc_id: str) -> list[str]:
    """The ends of a document id that may be the plan's name, longest first."""
    words = [w for w in doc_id.split("_") if w and not w.isdigit() and w != "doc"]
    return [shape(" ".join(words[-n:]))[0] for n in (3, 2, 1) if len(words) >= n]


def with_name(line: str, doc_id: str) -> str | None:
    """A folded line with the plan's name left out and its numbers as one, or None if it doesn't name it."""
    for name in plan_names(doc_id):
        if len(name) > 3 and re.search(rf"(?<!\w){re.escape(name)}(?!\w)", line):
            line = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", "\x01", line, count=1)
            return line
    return None


def one_form_of_words(text: str) -> str:
    """text with every word that has a Latin letter or a digit in one form of characters; odd spaces as plain ones.

    Words of other scripts, signs in formulas and pictures stay as they are; a lone Cyrillic
    letter in a text without a Cyrillic word stands for the Latin one it looks like.
    """
    if text.isascii():
        return text
    foreign = CYRILLIC_WORD.search(text) is not None

    def formed(m: re.Match) -> str:
        w = m[0]
        if not (LATIN.search(w) or any(map(str.isdigit, w)) or (not foreign and CYRILLIC.search(w))):
            return w
        return one_form(w)

    return UNUSUAL.sub(formed, SPACES.sub(" ", text))


def prepared(text: str) -> str:
    """text in one form of characters; hyphens at line ends, of any kind, stay as hyphens."""
    text = re.sub(rf"(?<=\w)[{HYPHEN}](?=[ \t]*\r?\n|[ \t]+[a-záéíóúüñ])", lambda m: SOFT if m[0] == "­" and "\n" not in text[m.end() : m.end() + 3] else "-", text)
    return one_form_of_words(text).replace("\r\n", "\n").replace("\r", "\n")


YEARS = re.compile(r"20\d\d|2[o0][\doisgb]{2}")


def title_key(line: str, doc_id: str) -> str | None:
    """What a line that names its plan has in common with the titles of other plans."""
    s = shape(line.strip())[0].strip()
    if len(s) < 8 or s[-1:] in ".,;:" or " " not in s:
        return None
    s = re.sub(r"^[\doisgb]{1,3} (?:\| )?|(?: \|)? [\doisgb]{1,3}$", "", s) if re.search(r"^\d{1,3}\s|\s\d{1,3}$", line.strip()) else s
    s = with_name(s, doc_id)
    return YEARS.sub("\x02", s) if s and len(s.replace("\x01", "")) >= 5 else None


@lru_cache(maxsize=1 << 12)
def title_pattern(key: str, name: str) -> re.Pattern:
    """A title of the plan of this name, in any year."""
    return re.compile("".join(r"[2z][o0][\doisgbz]{2}" if c == "\x02" else re.escape(name) if c == "\x01" else re.escape(c) for c in key))


def around_names(text: str, doc_id: str) -> set[str]:
    """What stands before and behind the plan's name in a folded text, 3 to REACH characters of it, years as one."""
    out = set()
    text = YEARS.sub("\x02", text)
    for name in plan_names(doc_id):
        if len(name) > 3:
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
                for n in range(3, REACH + 1):
                    out |= {"<" + text[max(0, m.start() - n) : m.start()], ">" + text[m.end() : m.end() + n]}
    return out


def beside_name(key: str) -> str:
    """The part of a title key beside the name by which it is looked up: of the longer side, up to REACH characters."""
    before, after = key.split("\x01", 1)
    return "<" + before[-REACH:] if len(before) >= len(after) else ">" + after[:REACH]


class Titles:
    """Finds the running titles of a plan in its texts, whole or damaged."""

    def __init__(self, keys: Iterable[str]):
        self.keys = sorted(keys, key=lambda k: (-len(k), k))
        # the longest stretch without name or year must stand in a text that has the title
        self.anchors = [max(re.split("[\x01\x02]", k), key=len) for k in self.keys]

    def spans(self, text: str, doc_id: str) -> list[tuple[int, int]]:
        if not self.keys:
            return []
        quick = folded_text(text)
        places = [i for i, a in enumerate(self.anchors) if a in quick]
        if not places:
            return []
        names = plan_names(doc_id)
        s, at = shape(text)
        out = []
        for place in places:
            for name in names:
                found = [m.span() for m in title_pattern(self.keys[place], name).finditer(s)]
                out += [(at[a], at[z - 1] + 1) for a, z in found if not any(at[a] < y and at[z - 1] >= x for x, y in out)]
                if found:
                    break
        return sorted(out)


@lru_cache(maxsize=1 << 10)
def titles_of(keys: tuple[str, ...]) -> Titles:
    return Titles(keys)


def layout_of(lines: list[tuple[str, str, bool]]) -> list[tuple[int, ...]]:
    """The layout of each line (text, form, whether it is cut out of a longer line), in the order of LAYOUT."""
    bare = [re.sub(r"\s+", " ", x).strip() for x, _, _ in lines]
    sizes = sorted(len(x) for x in bare if x)
    usual = max(1, sizes[len(sizes) * 3 // 4]) if sizes else 1
    filled = [k for k, x in enumerate(bare) if x]
    place_of = {k: i for i, k in enumerate(filled)}
    out = []
    for k, x in enumerate(bare):
        if not x:
            out.append((0, 2, 0, 0, 0, 0 if len(lines) == 1 else 1 if k == 0 else 2 if k == len(lines) - 1 else 3, 1))
            continue
        i = place_of[k]
        before, after = bare[filled[i - 1]] if i else "", bare[filled[i + 1]] if i + 1 < len(filled) else ""
        length = 0 if len(x) < 0.4 * usual else 1 if len(x) < 0.8 * usual else 2
        begins = 0 if x[0].islower() else 1 if x[0].isupper() else 2
        ends = 3 if x[-1] == ":" else 1 if x[-1] in ".!?…;" else 2 if x[-1] in ",-" else 0
        words = x.split(" ")
        capitals = 2 if x.isupper() and sum(map(str.isalpha, x)) > 3 else 1 if len(words) > 1 and 2 * sum(w[0].isupper() for w in words) >= len(words) else 0
        figures = sum(map(x.count, "0123456789"))
        digits = 0 if not figures else 2 if 2 * figures >= len(x) - x.count(" ") else 1
        place = 0 if len(filled) == 1 else 1 if i == 0 else 2 if i == len(filled) - 1 else 3
        short = lambda y: y and len(y) < 0.4 * usual
        around = 2 if (short(before) or not before) and (short(after) or not after) and (before or after) else 0 if before and after and before[-1] not in ".!?:;…" and (after[0].islower() or lines[k][2]) else 1
        out.append((length, begins, ends, capitals, digits, place, around))
    return out


def lines_of(text: str, doc_id: str, titles: Titles, cut: bool) -> list[tuple[str, tuple[int, ...], bool]]:
    """The lines of a prepared text: (line, what is seen of it, whether a number stands beside the title)."""
    pieces: list[tuple[str, str]] = []
    last = 0
    for a, z in titles.spans(text, doc_id):
        before, after = text[last:a], text[z:]
        beside = False
        if m := re.search(r"(?:^|\n)[ \t]*\d{1,4}[ \t]*(?:\|[ \t]*)?$|\s\d{1,4}[ \t]*\|[ \t]*$|\s\d{1,4}[ \t]{2,}$", before):
            before, beside = before[: m.start()], True
        if m := re.match(r"[ \t]*(?:\|[ \t]*)?\d{1,4}[ \t]*(?=\n|$)|[ \t]*\|[ \t]*\d{1,4}\b|[ \t]{2,}\d{1,4}\b", after):
            z, beside = z + m.end(), True
        pieces += [(before, "text"), (text[a:z], "title+" if beside else "title")]
        last = z
    pieces.append((text[last:], "text"))
    out: list[tuple[str, str, bool]] = []
    for piece, kind in pieces:
        if kind != "text":
            out.append((piece, kind, True))
            continue
        for line in piece.split("\n"):
            start = 0
            for m in INSIDE.finditer(line):
                if not (m[0].startswith("página") and REFERS.search(line[: m.start()])) and not (start == 0 and not line[: m.start()].strip() and not line[m.end() :].strip()):
                    out += [(line[start : m.start()], "text", False), (m[0], "mark", True)]
                    start = m.end()
            out.append((line[start:], "text", False))
    seen: list[tuple[str, tuple[int, ...], bool]] = []
    previous = ""
    n = len(out)
    for k, ((line, kind, _), layout) in enumerate(zip(out, layout_of(out))):
        bare = re.sub(r"\s+", " ", line).strip()
        if kind.startswith("title"):
            form = "title"
        elif kind == "mark" or MARK.match(bare):
            form = "mark"
        elif not bare:
            form = "blank"
        elif BARE.match(bare) and not (cut and k in (0, n - 1)):
            form = "bare"
        elif HEADING.match(bare) and not previous.endswith("-"):
            form = "heading"
        elif bare.endswith(":") and len(bare) < 30:
            form = "label"
        else:
            form = "text"
        if bare:
            previous = bare
        seen.append((line, (FORMS.index(form), *layout), kind == "title+"))
    return seen


class Labels:
    """The hidden Markov model of lines: of each state its forms, its kinds of layout and its next states."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = [np.array([t[s] for s in STATES]) for t in (MOVES, EMITS, *LAYOUT.values())] if tables is None else tables
        self.first = np.log(np.array(FIRST))
        logs = [np.log(t) for t in self.tables]
        self.moves, self.forms, self.layout = logs[0], logs[1], [LAYOUT_WEIGHT * t for t in logs[2:]]

    def evidence(self, seen: np.ndarray) -> np.ndarray:
        """Of lines (rows: form, then layout) the logarithm of how likely each state shows them."""
        out = self.forms[:, seen[:, 0]].T.copy()
        for k, table in enumerate(self.layout):
            out += table[:, seen[:, k + 1]].T
        return out

    def paths(self, texts: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
        """The likeliest states of the lines of each text, all texts at once."""
        if not texts:
            return []
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        shown = self.evidence(np.array([x for t in texts for x in t], dtype=np.int64))
        score = self.first + shown[starts[order]]
        back: list[np.ndarray] = []
        for t in range(1, int(sizes.max())):
            live = int((sizes[order] > t).sum())  # the longest stand first
            reached = score[:live, :, None] + self.moves
            back.append(reached.argmax(axis=1).astype(np.int8))
            score[:live] = reached.max(axis=1) + shown[starts[order[:live]] + t]
        out = [np.empty(n, dtype=np.int64) for n in sizes]
        state = score.argmax(axis=1)
        for t in range(int(sizes.max()) - 1, -1, -1):
            live = int((sizes[order] > t).sum())
            for i in range(live):
                out[order[i]][t] = state[i]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return out

    def path(self, text: list[tuple[int, ...]]) -> list[int]:
        return self.paths([text])[0].tolist()

    def trained(self, texts: list[list[tuple[int, ...]]], rounds: int = 3, weight: float = 200.0) -> "Labels":
        """Viterbi training: the written tables count as `weight` lines of each state."""
        model = self
        for _ in range(rounds if texts else 0):
            counts = [t * weight for t in Labels().tables]
            paths = model.paths(texts)
            states, seen = np.concatenate(paths), np.array([x for t in texts for x in t], dtype=np.int64)
            for k in range(seen.shape[1]):
                np.add.at(counts[k + 1], (states, seen[:, k]), 1)
            for p in paths:
                np.add.at(counts[0], (p[:-1], p[1:]), 1)
            model = Labels([c / c.sum(axis=1, keepdims=True) for c in counts])
        return model


def repaired(text: str, doc_id: str, titles: Titles, labels: Labels, cut: bool) -> tuple[str, bool, bool]:
    """The body of a text with its line ends, and whether a header and a page mark were taken out."""
    lines = lines_of(text, doc_id, titles, cut)
    return body_of(lines, labels.path([seen for _, seen, _ in lines]))


def body_of(lines: list[tuple[str, tuple[int, ...], bool]], path: Iterable[int]) -> tuple[str, bool, bool]:
    body, header, page = [], False, False
    taken = False
    for (line, seen, beside), state in zip(lines, path):
        kind = STATES[state]
        if kind == "header":
            header, page, taken = True, page or beside, True
        elif kind == "page":
            page, taken = True, True
        elif not line.strip():
            if not taken and body and body[-1] != "":
                body.append("")
            continue
        else:
            if taken and body and body[-1] == "":
                body.pop()  # the page's end is no paragraph's end
            body.append(line)
            taken = False
    return "\n".join(body), header, page


def fixes(word: str) -> Iterator[str]:
    """What a word may have been before one confusion of shapes."""
    seen = {word}
    for right, wrong in CONFUSIONS:
        start = word.find(wrong)
        while start >= 0:
            fixed = word[:start] + right + word[start + len(wrong) :]
            if fixed not in seen:
                seen.add(fixed)
                yield fixed
            start = word.find(wrong, start + 1)


def parts(m: re.Match) -> tuple[str, str, str]:
    """Both halves of a broken word, and how they stand in the text if it is none."""
    if m[1]:
        return m[1], m[2], f"{m[1]}-{m[2]}"
    return m[3], m[5], f"{m[3]} {m[5]}" if m[4] == SOFT else f"{m[3]}-{m[5]}"


def words_of(body: str, cut: bool) -> set[str]:
    """The words of a body, broken ones joined. Lower case, but a name within a sentence keeps its capital.

    Words at the edges of a cut text may be cut themselves and are left out.
    """
    plain = BROKEN.sub(lambda m: f"{m[3]} {m[5]}" if m[4] == SOFT else (m[1] or m[3]) + "\x00" + (m[2] or m[5]), body)
    out, found = set(), list(re.finditer(r"[^\W_\x00]+(?:[-\x00][^\W_\x00]+)*", plain))
    start = 0
    if cut and found:
        # what was cut may stand behind lines that were put before it
        lines = plain.split("\n")
        for line in lines[:-1]:
            bare = line.strip()
            if not (not bare or HEADING.match(bare) or bare.endswith(":") or re.fullmatch(r"\d+", bare) or re.match(r"[^\W\d_]+: ", bare)):
                break
            start += len(line) + 1
        edges = {found[0].start(), found[-1].start(), next((m.start() for m in found if m.start() >= start), 0)} | {m.start() for m in found if NOTE.match(plain, m.end())}
    else:
        edges = set()
    for m in found:
        if m.start() in edges:
            continue
        w = m[0].replace("\x00", "")
        before = plain[m.start() - 2 : m.start()] if m.start() > 1 else ""
        name = w[0].isupper() and not w.isupper() and before[:1].isalnum() and before[1:] in (" ", "\n") or w[0].isupper() and before[:1] == "," and not w.isupper()
        out.add(w[0] + w[1:].lower() if name else w.lower())
    return out


def paragraphs(body: str, compounds: set[str], corrections: dict[str, str]) -> str:
    """A body put together: broken words joined, misread words corrected, one line for each paragraph."""

    def joined(m: re.Match) -> str:
        left, right, apart = parts(m)
        return apart if apart.lower() in compounds else left + right

    text = BROKEN.sub(joined, body)
    text = re.sub(r"(?<!\n)\n(?!\n)", " ", text)

    def corrected(m: re.Match) -> str:
        right = corrections.get(m[0]) or corrections.get(m[0].lower())
        if right is None:
            return m[0]
        return right.upper() if m[0].isupper() else right.capitalize() if m[0][0].isupper() else right

    return re.sub(r"[ \t]+", " ", WORD.sub(corrected, text).replace(SOFT, "")).strip()


STRINGS = lambda *names: StructType([StructField(n, StringType()) for n in names])


def batch(schema_names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(schema_names))], names=schema_names)


def running_titles(texts: DataFrame) -> DataFrame:
    """title and near (what it is looked up by) of the keys that head at least two plans, or stand in three texts of one, counted over all texts."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = plan_names(doc)
                # the shortest name ends all others: without it no line names the plan
                if names and ("\n" in text or "\r" in text) and names[-1] in folded_text(text):
                    rows += {(k, doc, beside_name(k)) for line in prepared(text).split("\n") if (k := title_key(line, doc))}
            yield batch(["title", "doc", "near"], rows)

    counted = texts.select("doc", "text").mapInArrow(keys, STRINGS("title", "doc", "near")).groupBy("title", "near", "doc").count().groupBy("title", "near").agg(F.count("*").alias("plans"), F.max("count").alias("most"))
    return counted.where("plans > 1 OR most > 2").select("title", "near")


def titles_by_plan(texts: DataFrame) -> DataFrame:
    """doc and titles: of each plan the keys whose part beside the name stands beside the plan's name in its texts."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = set()
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names = plan_names(doc)
                if names and names[-1] in (quick := folded_text(prepared(text))):
                    rows |= {(doc, near) for near in around_names(quick, doc)}
            yield batch(["doc", "near"], list(rows))

    near = texts.select("doc", "text").mapInArrow(places, STRINGS("doc", "near")).distinct()
    # a plan's titles are bounded by what stands beside its name
    return near.join(running_titles(texts), "near").groupBy("doc").agg(F.sort_array(F.collect_set("title")).alias("titles"))


class Scan:
    """What noise() and repaired_fields() share: one reading of all texts and the corpus's words."""

    def __init__(self, df: DataFrame, key: str, doc: str, fields: list[str], cut_fields: list[str] = (), sample: int = SAMPLE):
        self.key = key
        self.seen, self.counts, self.misread = scanned(df, key, doc, fields, cut_fields, sample)
        broken = self.seen.where("what = 'broken'")
        compound = self.counts.where("word LIKE '%-%'").select(F.col("word").alias("b"), F.col("n").alias("nc"))
        self.broken = broken.join(self.counts.select(F.col("word").alias("a"), F.col("n").alias("nj")), "a", "left").join(compound, "b", "left")
        # a compound's own hyphen, if the corpus writes it so; a soft hyphen between two words, if it doesn't write them as one
        self.broken = self.broken.withColumn("compound", F.when(F.col("b").contains(" "), F.coalesce("nj", F.lit(0)) < 2).otherwise(F.coalesce(F.col("nc") >= F.coalesce("nj", F.lit(0)), F.lit(False))))
        words = self.seen.where("what = 'body'").select("key", "field", F.explode("ws").alias("a"))
        bad = self.misread.select(F.col("bad").alias("a"), "good")
        # few words are misread in a corpus of any size that is read once; past the bound the words are shuffled to them
        self.wrong = words.join(F.broadcast(bad) if self.misread.count() <= MISREAD_ROWS else bad, "a")


def noise(df: DataFrame, key: str, doc: str, fields: list[str], cut_fields: list[str] = (), sample: int = SAMPLE) -> DataFrame:
    """key, field_name and kind (hyphen, misread, header, page_number) of the noise in each field, distinct.

    One row of df for each key. Null and empty fields have no noise. cut_fields are cut out of a
    text: a number alone on their first or last line is no page mark. Extra columns aren't read.
    """
    scan = Scan(df, key, doc, fields, cut_fields, sample)
    plain = scan.seen.where("what IN ('header', 'page_number')").select("key", "field", F.col("what").alias("kind"))
    found = plain.unionByName(scan.wrong.select("key", "field", F.lit("misread").alias("kind"))).unionByName(scan.broken.where("NOT compound").select("key", "field", F.lit("hyphen").alias("kind"))).distinct()
    return found.select(F.col("key").alias(key), F.col("field").alias("field_name"), "kind")


def repaired_fields(df: DataFrame, key: str, doc: str, fields: list[str], cut_fields: list[str] = (), sample: int = SAMPLE) -> DataFrame:
    """key, field_name and repaired: each non-empty field as continuous paragraphs, one line each, as noise() reads it.

    Headers and page marks are gone, broken words joined, misread ones corrected; texts without
    noise keep their words. Null and empty fields give no row.
    """
    scan = Scan(df, key, doc, fields, cut_fields, sample)
    # a field's corrections and compounds are bounded by its own words
    right = scan.wrong.groupBy("key", "field").agg(F.collect_set(F.struct("a", "good")).alias("right"))
    kept = scan.broken.where("compound").groupBy("key", "field").agg(F.collect_set("b").alias("kept"))
    bodies = scan.seen.where("what = 'body'").select("key", "field", F.col("a").alias("body")).join(right, ["key", "field"], "left").join(kept, ["key", "field"], "left")

    def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(k, f, paragraphs(body, set(c or ()), {x["a"]: x["good"] for x in r or ()})) for k, f, body, r, c in zip(*(b.column(i).to_pylist() for i in range(5)))]
            yield batch([key, "field_name", "repaired"], rows)

    return bodies.select("key", "field", "body", "right", "kept").mapInArrow(put_together, STRINGS(key, "field_name", "repaired"))


def scanned(df: DataFrame, key: str, doc: str, fields: list[str], cut_fields: list[str], sample: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What was seen in each text, the counts of words, and misread words with what they were: all checkpointed or small."""
    spark = df.sparkSession
    stacked = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("doc"), *(F.col(f).alias(f) for f in fields)).where("key IS NOT NULL")
    texts = stacked.select("key", "doc", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x")).select("key", "doc", "x.field", "x.text").where("text IS NOT NULL AND text <> ''")
    titles = checkpointed(titles_by_plan(texts)).withColumnRenamed("doc", "__doc")  # read by the sample and by the reading
    titled = lambda rows: rows.join(titles, F.col("doc") == F.col("__doc"), "left").drop("__doc")
    chosen = titled(below_cutoff(texts.where(F.length("text") < 20_000), ["key", "field"], sample)).collect()  # about 1.2 SAMPLE rows
    labels = Labels().trained([[x for _, x, _ in lines_of(prepared(r["text"]), r["doc"], titles_of(tuple(r["titles"] or ())), r["field"] in cut_fields)] for r in chosen])
    shared = spark.sparkContext.broadcast(labels.tables)  # a few small tables

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labels(shared.value)
        for b in sliced(batches):
            rows, todo = [], []
            for key_, doc_, *values, own in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                find = titles_of(tuple(own or ()))
                todo += [(key_, field, lines_of(prepared(text), doc_, find, field in cut_fields)) for field, text in zip(fields, values) if text]
            for (key_, field, lines), path in zip(todo, model.paths([[x for _, x, _ in lines] for _, _, lines in todo])):
                body, header, page = body_of(lines, path)
                # a text's words travel with it, in one row
                same = blake2b(" ".join(body.split()).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                rows.append((key_, field, "body", body, same, sorted(w for w in words_of(body, field in cut_fields) if not w.isdigit())))
                if header:
                    rows.append((key_, field, "header", None, None, None))
                if page:
                    rows.append((key_, field, "page_number", None, None, None))
                rows += [(key_, field, "broken", *x, None) for x in {((x + y).lower(), apart.lower()) for x, y, apart in map(parts, BROKEN.finditer(body))}]
            names = ["key", "field", "what", "a", "b"]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(5)), pa.array([r[5] for r in rows], pa.list_(pa.string()))], names=[*names, "ws"])

    seen = checkpointed(titled(stacked).select("key", "doc", *fields, "titles").mapInArrow(read, StructType([*STRINGS("key", "field", "what", "a", "b"), StructField("ws", ArrayType(StringType()))])))
    # a text that stands under many keys counts once: neither its misread words nor its right ones grow common by it;
    # its copies have one list of words, or a few where they are cut, and counts are combined before they are shuffled
    once = seen.where("what = 'body'").groupBy("b").agg(F.array_distinct(F.flatten(F.collect_set("ws"))).alias("ws"))
    counts = checkpointed(once.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("n")))

    def guesses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(w, g, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(w) > 2 for g in fixes(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["bad", "good", "nb"])

    tried = counts.where("word NOT LIKE '%-%'").mapInArrow(guesses, StructType([StructField("bad", StringType()), StructField("good", StringType()), StructField("nb", LongType())]))
    misread = tried.join(counts.select(F.col("word").alias("good"), F.col("n").alias("ng")), "good").where((F.col("ng") >= COMMON) & (F.col("ng") >= RATIO * F.col("nb")))
    misread = checkpointed(misread.groupBy("bad").agg(F.max(F.struct("ng", "good")).alias("m")).select("bad", F.col("m.good").alias("good")))
    return seen, counts, misread
