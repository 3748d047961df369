"""Name normalisation as column expressions; all of them stay in the engine's own code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Arabic script ranges, the articles, and the locality words that carry no name.
ARABIC_RANGES = r"[؀-ۿݐ-ݿࢠ-ࣿ]"
ARTICLES = ("al", "el", "the", "le", "la", "de", "du")
LOCALITY_WORDS = ("وادي", "واديه", "واديّ", "حي", "حيه", "حيّ", "ال", "منارة", "منار", "منطقه", "منطقة")
ARABIC_ARTICLE = "ال"


def strip(c: Column) -> Column:
    """Trim any Unicode white space, line ends too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def separators_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "[-_]", " ")


def name_key(c: Column) -> Column:
    """Lower case, with hyphens and underscores as spaces."""
    return F.lower(separators_to_spaces(strip(c)))


def words(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def drop_latin_article(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(al|el)[\s\-_:]+", "")


def drop_arabic_article(c: Column) -> Column:
    return F.regexp_replace(c, rf"^\s*{ARABIC_ARTICLE}[\s\-_:]*", "")


def drop_token_article(c: Column) -> Column:
    return F.regexp_replace(c, f"^{ARABIC_ARTICLE}", "")


def drop_locality_words(c: Column) -> Column:
    """Words without their article; locality words go, with or without one."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s\-–—]+"), lambda w: w != "")
    bare = drop_token_article
    stays = F.filter(parts, lambda w: ~w.isin(*LOCALITY_WORDS) & ~bare(w).isin(*LOCALITY_WORDS))
    return F.array_join(F.transform(stays, bare), " ")


def has_arabic(c: Column) -> Column:
    return c.rlike(ARABIC_RANGES)


def is_article(c: Column) -> Column:
    return c.rlike("(?i)^(" + "|".join(ARTICLES) + ")$")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def glue_article(c: Column) -> Column:
    """At the first "el", then the first "al", drop one space that follows."""
    out = c
    for article in ("el", "al"):
        out = F.regexp_replace(out, f"^((?:(?!{article}).)*{article}) ", "$1")
    return out


def article_variants(c: Column) -> Column:
    """For a single word: itself, with the article before it, and without either article; distinct and not empty."""
    variants = F.array(c, F.concat(F.lit("el"), c), F.replace(c, F.lit("el"), F.lit("")), F.replace(c, F.lit("al"), F.lit("")))
    return F.when(F.size(words(c)) == 1, F.array_distinct(F.filter(variants, lambda v: v != ""))).otherwise(F.array(c))


def within_length(a: Column, b: Column, most: int = 2) -> Column:
    """Whether the lengths differ by ``most`` at most."""
    return F.abs(F.length(a) - F.length(b)) <= most


def quoted_list(values: Column) -> Column:
    """``["a","b"]`` with the strings as they are."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ","), F.lit("]"))
