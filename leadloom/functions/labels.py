"""Countries and seniority levels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.vocab import COUNTRIES, COUNTRY_ALIASES, NOT_PRESIDENT, SENIORITIES, SENIORITY_ALIASES, TITLE_WORDS
from leadloom.values import let, looked_up, one_of


def _name_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def normalize_country(clean: Column) -> Column:
    """ISO code of a known country, else the clean text itself."""
    known = {v.casefold(): k for k, v in COUNTRIES.items()} | COUNTRY_ALIASES
    return F.when(one_of(F.upper(clean), COUNTRIES), F.upper(clean)).otherwise(F.coalesce(looked_up(_name_key(clean), known), clean))


def country_code(text: str) -> str | None:
    """The code of a country term on the driver."""
    key = re.sub(r"[^a-z0-9 ]+", " ", text.casefold()).strip()
    upper = text.strip().upper()
    return upper if upper in COUNTRIES else COUNTRY_ALIASES.get(key) or {v.casefold(): k for k, v in COUNTRIES.items()}.get(key)


def country_is(country: Column, term: str) -> Column:
    """Whether a normalized country is the one a term names, by code, name or alias."""
    key = re.sub(r"[^a-z0-9 ]+", " ", term.casefold()).strip()
    code = country_code(term)
    same = (F.upper(country) == term.strip().upper()) | (_name_key(country) == key)
    return same | (country == code) if code else same


def coerce_seniority(c: Column) -> Column:
    """A seniority level written in some way, ``unknown`` for any other text."""
    key = F.translate(F.lower(F.trim(c)), "- ", "__")
    return F.coalesce(looked_up(key, {s: s for s in SENIORITIES} | SENIORITY_ALIASES), F.lit("unknown"))


def title_pattern(words: tuple[str, ...]) -> str:
    """One alternation of a level's words."""
    parts = []
    for w in words:
        if w == "president":
            parts.append("".join(f"(?<!{x} )" for x in NOT_PRESIDENT) + r"\bpresident\b")
        elif w.startswith("|"):
            parts.append(rf"\b{w.strip('|')}\b")
        else:
            parts.append(re.sub(r"([.+])", r"\\\1", w))
    return "|".join(parts)


def infer_seniority(title: Column) -> Column:
    """The most senior level that a clean title has a word of."""

    def level(t: Column) -> Column:
        out = F.when(t.isNull(), "unknown")
        for name, words in TITLE_WORDS.items():
            out = out.when(t.rlike(title_pattern(words)), name)
        return out.otherwise("unknown")

    return let(F.concat(F.lit(" "), F.translate(F.lower(title), "/|,", "   "), F.lit(" ")), level)
