"""Text functions: Column in, Column out. All stay in generated code; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain letters.
MARKED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc"
HEADING_LETTERS = "A-ZÁÉÍÓÚÑ"


def squished(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def normalized(text: Column) -> Column:
    """Line ends as newlines, runs of blanks as one, none beside a newline, at most one empty line."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, "[ \t\xa0]+", " ")
    x = F.regexp_replace(x, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, "\n{3,}", "\n\n"))


def folded(text: Column) -> Column:
    """Lower case, plain letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def slug(text: Column, sep: str = "-") -> Column:
    return F.regexp_replace(folded(text), " ", sep)


def doc_id(name: Column) -> Column:
    return F.concat(F.lit("doc_"), slug(name, "_"))


def leading_part(path: Column) -> Column:
    """A file's name up to its first " - ", without folder and ending."""
    return F.trim(F.split(F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(?i)\.[a-z0-9]{1,5}$", ""), " - ", 2)[0])


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_page_number(line: Column) -> Column:
    x = F.lower(squished(line))
    return x.rlike(r"^p[aá]gina [0-9]+( de [0-9]+)?$") | x.rlike(r"^[0-9]+ ?/ ?[0-9]+$") | x.rlike(r"^[-–—]? ?[0-9]+ ?[-–—]?$")


def is_heading(line: Column) -> Column:
    x = squished(line)
    numbered = x.rlike(rf"^([0-9]+([.][0-9]+)*|[IVXLCM]+)[.)-]?\s+[{HEADING_LETTERS}].+")
    capitals = (x == F.upper(x)) & x.rlike(f"[{HEADING_LETTERS}]")
    titled = x.rlike(rf"^[{HEADING_LETTERS}][A-Za-zÁÉÍÓÚáéíóúÑñÜü ]{{3,80}}$") & (F.length(x) - F.length(F.replace(x, F.lit(" "))) <= 8)
    return F.length(x).between(4, 140) & (numbered | capitals | titled)


def dehyphenated(text: Column) -> Column:
    """Words broken at a line end joined; lines joined where a sentence goes on."""
    x = F.regexp_replace(text, r"(\p{L})-\n(\p{L})", "$1$2")
    return F.regexp_replace(x, r"([\p{L}\p{N},;:])\n(\p{Ll}|\p{N})", "$1 $2")


def sentences(text: Column) -> Column:
    """Sentences of a text: cut behind . ! ? … before white space."""
    return F.split(F.regexp_replace(text, r"([.!?…])\s+", "$1\x01"), "\x01")


BULLET = r"^\s*(?:[-•*]|[0-9]+[.)]|[a-zA-Z]\))\s+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), 1)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}+"))


def token_set(text: Column, stopwords: list[str]) -> Column:
    """Distinct folded words of at least 3 letters, without stopwords."""
    return F.array_except(F.filter(F.split(folded(text), " "), lambda w: F.length(w) >= 3), F.array(*(F.lit(w) for w in stopwords)))


def without_boilerplate(text: Column, pattern: str) -> Column:
    x = F.regexp_replace(folded(text), pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(on|oe) ?[0-9]+\b", " "), " +", " "))


def snippet(document: Column, statement: Column, around: int = 250, needle: int = 120) -> Column:
    """What stands around a statement in its document, or the statement's beginning."""
    key = F.substring(F.lower(squished(statement)), 1, needle)
    at = F.position(key, F.lower(document))
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(document), at + F.length(key) - 1 + around)
    return F.when(at == 0, F.substring(squished(statement), 1, 2 * around)).otherwise(F.substr(document, start, end - start + 1))
