"""Headcounts written in many shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.values import let

# The largest headcount that is believed, and the words dropped around a headcount.
MAX_HEADCOUNT = 2_000_000
HEADCOUNT_WORDS = "employees|employee|staff|people|headcount|approx|about"


SHAPE = "(?i)^([0-9]+(?:\\.[0-9]+)?)\\s*([kmb]?)$"


def scalar_count(c: Column) -> Column:
    """``1,200``, ``1.2k``, ``1000+`` as a whole number; null for anything else."""

    def read(t: Column) -> Column:
        number = F.regexp_extract(t, SHAPE, 1).try_cast("double")
        factor = let(F.lower(F.regexp_extract(t, SHAPE, 2)), lambda u: F.when(u == "k", 1e3).when(u == "m", 1e6).when(u == "b", 1e9).otherwise(1.0))
        return F.when(t.rlike(SHAPE), (number * factor).try_cast("bigint"))

    return let(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), "\\++$", "")), "[,_]", ""), read)


def parse_employee_count(c: Column | str) -> Column:
    """Headcount of a cell; of a band its lower end. Null when it is unreadable."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, "[\\u00A0\\u2000-\\u200A\\u202F\\u3000]", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[\\x00-\\x1F\\x7F\\u200B-\\u200F\\uFEFF]", ""), "\\s+", " "))
    t = F.regexp_replace(t, f"(?iU)\\b(?:{HEADCOUNT_WORDS})\\b\\.?", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "~", " "), ",", ""))

    def first(t: Column) -> Column:
        parts = F.filter(F.split(t, "(?i)\\s*(?:-|–|—|to)\\s*"), lambda x: F.trim(x) != "")
        return let(parts, lambda p: F.when(F.size(p) > 1, F.get(p, F.lit(0))).otherwise(t))

    return scalar_count(let(t, first))


def plausible(c: Column) -> Column:
    return let(c, lambda n: F.when((n >= 0) & (n <= MAX_HEADCOUNT), n))


def _whole(text: str) -> int | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmb]?)", re.sub("[,_]", "", text.strip().rstrip("+")).strip(), re.IGNORECASE | re.ASCII)
    return int(float(m[1]) * {"": 1, "k": 1e3, "m": 1e6, "b": 1e9}[m[2].lower()]) if m else None


def band(value) -> tuple[int, int] | None:
    """Both ends of a headcount band of the configuration (``201-500``, ``201 to 500``, ``201,500``), on the driver; null where it is none."""
    text = " ".join(str(value if value is not None else "").split())
    if m := re.fullmatch(r"(\d+) ?, ?(\d+)", text, re.ASCII):
        low, high = int(m[1]), int(m[2])
    else:
        ends = [_whole(x) for x in re.split(r"\s*(?:-|–|—|\bto\b)\s*", text, flags=re.IGNORECASE) if x.strip()]
        if len(ends) != 2 or None in ends:
            return None
        low, high = ends
    return (low, high) if low <= high else None
