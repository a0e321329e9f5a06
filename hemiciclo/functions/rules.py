"""Rule operators over a text column, each parameterised by a pack of hemiciclo.functions.lexicons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemiciclo.functions import lexicons as lex


def occurrences(text: Column, key: str) -> Column:
    """How often a substring stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(key)))) / len(key)).cast("int")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def topic(text: Column, pack: dict[str, list[str]] = lex.AXES, none: str = "otros") -> Column:
    """struct(axis, confidence): the topic with most substring hits (ties: first of the pack) and its share."""

    def hits(t: Column) -> Column:
        return F.array(*(F.struct(reduce(lambda a, b: a + b, [occurrences(t, k) for k in keys]).alias("n"), F.lit(-i).alias("o"), F.lit(axis).alias("axis")) for i, (axis, keys) in enumerate(pack.items())))

    def chosen(h: Column) -> Column:
        return bound(
            F.struct(F.array_max(h).alias("best"), F.aggregate(h, F.lit(0), lambda a, x: a + x["n"]).alias("total")),
            lambda s: F.struct(F.when(s["total"] > 0, s["best"]["axis"]).otherwise(none).alias("axis"), F.when(s["total"] > 0, s["best"]["n"] / s["total"]).otherwise(0.0).alias("confidence")),
        )

    return bound(F.lower(text), lambda t: bound(hits(t), chosen))


def first_class(text: Column, pack: list[tuple[str, str]] = lex.INSTRUMENTS, none: str = "unspecified") -> Column:
    def chosen(lower: Column) -> Column:
        chain = F.when(lower.rlike(pack[0][1]), pack[0][0])
        for name, pattern in pack[1:]:
            chain = chain.when(lower.rlike(pattern), name)
        return chain.otherwise(none)

    return bound(F.lower(text), chosen)


def tags(text: Column, keys: list[str]) -> Column:
    """The keys that match, joined by "; ", or null."""
    hit = bound(F.lower(text), lambda t: F.array_compact(F.array(*(F.when(t.rlike(k), F.lit(k)) for k in keys))))
    return F.nullif(F.array_join(hit, "; "), F.lit(""))


def first_match(text: Column, pattern: str = lex.EVIDENCE) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), f"({pattern})", 1), F.lit(""))


def numbers(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({lex.NUMBER})"), 1))
    return F.when(F.size(found) > 0, F.array_join(found, ";"))


def has(text: Column, pattern: str) -> Column:
    return F.lower(text).rlike(pattern)


def quant(text: Column) -> Column:
    return has(text, lex.HAS_NUMBER) & has(text, lex.TARGET)


def horizon(text: Column) -> Column:
    return has(text, lex.HORIZON)


def vague(text: Column) -> Column:
    return has(text, lex.VAGUE) & ~quant(text) & ~horizon(text) & (first_class(text) == "unspecified")


def annotated(df, text: str):
    """df with the rule columns of a text; null texts get null features and score 0."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    t = F.col(text)
    df = df.withColumns({
        "topic": topic(t), "instrument": first_class(t), "population": tags(t, lex.POPULATIONS), "territory": tags(t, lex.TERRITORIES), "evidence": first_match(t), "numbers": numbers(t),
        "quant": quant(t), "horizon": horizon(t), "cost": has(t, lex.COST), "funding": has(t, lex.FUNDING), "weak": has(t, lex.VAGUE),
    }).withColumn("vague", F.col("weak") & ~F.col("quant") & ~F.col("horizon") & (F.col("instrument") == "unspecified")).drop("weak")
    score = points(F.col("quant"), 20) + points(F.col("horizon"), 15) + points(F.col("instrument") != "unspecified", 15) + points(F.col("population").isNotNull(), 10) + points(F.col("territory").isNotNull(), 10) + points(F.col("cost") | F.col("funding"), 10) + points(F.col("evidence").isNotNull(), 10) - points(F.col("vague"), 10)
    return df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))


def spanish_number(token: Column) -> Column:
    """1.500,50 / 3,5 / 1.000.000 / 3.5 as a double, or null."""
    dots = F.length(token) - F.length(F.replace(token, F.lit(".")))
    bare = F.replace(token, F.lit("."))
    text = F.when(F.contains(token, F.lit(",")), F.replace(bare, F.lit(","), F.lit("."))).when(dots > 1, bare).otherwise(token)
    return text.try_cast("double")


AMOUNT = r"([0-9]+(?:[.,][0-9]+)*)\s*(mil\s+millones|millones|miles)?"
MONEY = r"s/\.?|soles|presupuesto|inversi[oó]n|gasto|financ|millones"


def amounts(text: Column) -> Column:
    """The amounts of a text that speaks of money, in the order they stand: array of doubles above 0."""
    lower = F.lower(text)
    values = F.transform(
        F.arrays_zip(F.regexp_extract_all(lower, F.lit(AMOUNT), 1).alias("n"), F.regexp_extract_all(lower, F.lit(AMOUNT), 2).alias("u")),
        lambda x: spanish_number(x["n"]) * F.when(x["u"].startswith("mil "), 1e9).when(x["u"] == "millones", 1e6).when(x["u"] == "miles", 1e3).otherwise(1.0),
    )
    return F.when(lower.rlike(MONEY), F.filter(values, lambda v: v > 0)).otherwise(F.array().cast("array<double>"))


def mentions(text_folded: Column, keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text_folded, F.lit(k)) for k in keys])


def recoded(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    if not labels:
        return value
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), value)


def reclassified(text: Column, before: list[tuple[str, str]], given: Column, keep: list[str], after: list[tuple[str, str]], none: str = "otros") -> Column:
    """An ordered choice: the first pattern of `before`, then the given class if it is one to keep, then `after`."""
    t = F.coalesce(text, F.lit(""))
    steps = [(t.rlike(p), F.lit(name)) for name, p in before] + [(F.coalesce(given.isin(keep), F.lit(False)), given)] + [(t.rlike(p), F.lit(name)) for name, p in after]
    chain = F.when(*steps[0])
    for condition, name in steps[1:]:
        chain = chain.when(condition, name)
    return chain.otherwise(none)


def first_plausible(numbers_: Column, text: Column, low: Column, high: Column) -> Column:
    """The first number, of the joined numbers and then of the text, that lies in [low, high]; null if none does."""
    found = F.array_distinct(F.concat(F.coalesce(F.split(numbers_, ";"), F.array().cast("array<string>")), F.coalesce(F.regexp_extract_all(text, F.lit(f"({lex.NUMBER})"), 1), F.array().cast("array<string>"))))
    values = F.filter(F.transform(found, spanish_number), lambda v: v.isNotNull() & (v >= low) & (v <= high))
    return F.get(values, F.lit(0))


def milestone(first_year: Column, first: Column, last: Column, year: int, last_year: int = 2031) -> Column:
    """The value at `year` on the line from the first value to the last."""
    return first + (last - first) * (F.lit(year) - first_year) / F.greatest(F.lit(1), F.lit(last_year) - first_year)


def seeded(text: Column, predicted: Column) -> Column:
    """Whether a sentence is taken as a proposal before anyone judged it: predicted ones with an action or an obligation, others with both."""
    lower = F.lower(text)
    action, obligation = lower.rlike("(?U)" + lex.ACTION), lower.rlike("(?U)" + lex.OBLIGATION)  # letters with marks are letters
    return F.when(predicted, action | obligation).otherwise(action & obligation)


def signal(score: Column, axis_prob: Column, instrument_prob: Column) -> Column:
    """How strongly a statement takes a stance, in [0, 1]; nulls count as 0."""
    part = lambda c, w: F.coalesce(c, F.lit(0.0)) * w
    return part(score / 100, 0.5) + part(axis_prob, 0.3) + part(instrument_prob, 0.2)


def topic_phrase(label: Column, pack: list[tuple[str, str]] = lex.TOPIC_PHRASES) -> Column:
    """The phrase for the words of a topic; without one its first three words, or a phrase for none."""
    lower = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    chain = F.when(lower.rlike(pack[0][1]), pack[0][0])
    for phrase, pattern in pack[1:]:
        chain = chain.when(lower.rlike(pattern), phrase)
    parts = F.slice(F.array_distinct(F.filter(F.transform(F.split(lower, r",\s*"), lambda x: F.trim(x)), lambda x: x != "")), 1, 3)
    sentence = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return chain.otherwise(F.when(F.size(parts) > 0, F.array_join(sentence, " · ")).otherwise("Agenda programática prioritaria"))


def with_defaults(df, doc: str, snippet: str, text: str, missing: str = "doc_missing"):
    """df whose blank document ids and snippets have a default: a name, and the statement's beginning."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return df.withColumns({doc: F.when(blank(doc), missing).otherwise(F.col(doc)), snippet: F.when(blank(snippet), F.substring(text, 1, 250)).otherwise(F.col(snippet))})
