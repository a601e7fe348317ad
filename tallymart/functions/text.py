"""Text functions built from Spark's own: tokens, price bounds, clauses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CHEAP, EN_MAX, EN_MIN, EXPENSIVE, MAX_BUDGET, MAX_PREFIX, MAX_SUFFIX, MIN_SUFFIX

CJK = r"一-鿿"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased words; runs of CJK characters become their bigrams (a single one stays). Null gives an empty array. Texts without CJK take one pass."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}_&&[^{CJK}]]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.when(low.rlike(f"[{CJK}]"), F.concat(words, pairs)).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def contains_any(text: Column | str, terms: Sequence[str]) -> Column:
    """Whether any term is contained, whatever its case; false for null."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(low, t)) if terms else F.lit(False)


def first_rule(text: Column | str, rules: Sequence[tuple[object, Sequence[str]]], make=F.lit) -> Column:
    """Value of the first rule, in table order, of which a term is contained; null if there is none."""
    if not rules:
        return F.lit(None)
    return F.coalesce(*(F.when(contains_any(text, terms), make(value)) for value, terms in rules))


def number(text: Column | str, pattern: str) -> Column:
    """First group of the first match as a number; null without one, and for zero."""
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), pattern, 1)
    return F.nullif(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))


def price_max(text: Column | str) -> Column:
    """Upper price bound: suffix, prefix, budget, then English forms."""
    return F.coalesce(*(number(text, p) for p in (MAX_SUFFIX, MAX_PREFIX, MAX_BUDGET, EN_MAX)))


def price_min(text: Column | str) -> Column:
    return number(text, MIN_SUFFIX)


def price_intent(text: Column | str) -> Column:
    """Struct (direction, low, high): complaints invert, else one-sided words, else the only bound implies it."""
    t = F.coalesce(col(text), F.lit(""))

    def first(*patterns: str) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("double") for p in patterns))

    high, low = first(MAX_SUFFIX, MAX_PREFIX, EN_MAX), first(MIN_SUFFIX, EN_MIN)
    too_cheap, too_dear = t.rlike("太便宜|嫌便宜|不够贵|不够高端"), t.rlike("太贵|嫌贵|不够便宜")
    cheap, dear = t.rlike(CHEAP), t.rlike(EXPENSIVE)
    direction = (
        F.when(too_cheap & ~too_dear, "expensive")
        .when(too_dear & ~too_cheap, "cheap")
        .when(cheap & ~dear, "cheap")
        .when(dear & ~cheap, "expensive")
        .when(high.isNotNull() & low.isNull(), "cheap")
        .when(low.isNotNull() & high.isNull(), "expensive")
    )
    return F.struct(direction.alias("direction"), low.alias("low"), high.alias("high"))


def expansion_terms(text: Column | str, table: Mapping[str, Sequence[str]], stop: Sequence[str], most: int = 8) -> Column:
    """Reviewed synonyms of triggers found, in table order, not those already in the text; none beside price words."""
    if not table:
        return F.array().cast("array<string>")
    base = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    found = [F.when(F.contains(base, F.lit(k.lower())), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in table.items()]
    every = F.filter(F.flatten(F.array(*found)), lambda t: ~F.contains(base, F.lower(t)))
    kept = F.slice(F.array_distinct(every), 1, most)
    return F.when(contains_any(base, stop) | (base == ""), F.array().cast("array<string>")).otherwise(kept)


def english_hints(text: Column | str, table: Sequence[tuple[str, str]]) -> Column:
    """Category words of English shopping words found (leading boundary only), none if the text has CJK."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    found = F.filter(F.array(*(F.when(low.rlike(rf"(?U)\b\Q{en}\E"), F.lit(zh)) for en, zh in table)), lambda x: x.isNotNull())
    return F.when(low.rlike(f"[{CJK}]"), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def augment(text: Column | str, hints: Column) -> Column:
    return F.when(F.size(hints) > 0, F.concat_ws(" ", col(text), F.array_join(hints, " "))).otherwise(col(text))
