"""Parsers for the answers of transliteration and geocoder services, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country code that a geocoder's answer must name.
COUNTRY = "lb"


def jsonp_body(c: Column) -> Column:
    """What stands between the callback's parentheses; text without a callback as it is, from its first brace."""
    body = F.regexp_extract(c, r"(?s)^\s*[\w.$]+\s*\((.*)\)\s*;?\s*$", 1)
    return F.when(body != "", body).otherwise(from_first_brace(c))


def from_first_brace(c: Column) -> Column:
    at = F.locate("{", c)
    return F.when(at > 0, c.substr(at, F.length(c))).otherwise(c)


def candidates(c: Column) -> Column:
    """``A/1|B/2`` to its candidates, in order, without empty ones."""
    return F.filter(F.split(c, r"/[0-9]\|?"), lambda v: v != "")


def arabic_runs(c: Column) -> Column:
    """Distinct runs of Arabic script of two signs or more, spaces and hyphens inside them."""
    runs = F.regexp_extract_all(c, F.lit(r"([؀-ۿݐ-ݿࢠ-ࣿ][؀-ۿݐ-ݿࢠ-ࣿ\s\-]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(runs, lambda v: F.trim(v)), lambda v: v != ""))


def _field(body: Column, name: str) -> Column:
    """A field of a JSON object; single quotes are read as well."""
    return F.from_json(body, f"{name} string")[name]


def transliterations(c: Column) -> Column:
    """Candidates of an answer ``callback({"data": "{\\"r\\": ...}"})``; an answer that can't be parsed gives its Arabic runs."""
    inner = _field(jsonp_body(c), "data")
    packed = F.coalesce(_field(inner, "r"), F.nullif(F.regexp_extract(c, r"""[\\]*["']r[\\]*["']\s*[:=]\s*[\\]*["']([^"'\\]*)""", 1), F.lit("")))
    return F.when(packed.isNull(), F.coalesce(arabic_runs(c), F.array().cast("array<string>"))).otherwise(candidates(packed))


def geocoder_hit(c: Column, strict: bool = False) -> Column:
    """Whether an answer holds a place: not empty, and the country named; ``strict`` reads the address itself."""
    some = (F.trim(c) != "[]") & F.lower(c).contains(COUNTRY)
    return some & (F.lower(F.get_json_object(c, "$[0].address.country_code")) == COUNTRY) if strict else some


def place_name(c: Column) -> Column:
    """The first of city, village, town and county in an answer's address."""
    return F.coalesce(*(F.get_json_object(c, f"$[0].address.{level}") for level in ("city", "village", "town", "county")))
