"""Text of cells as Column expressions; compatibility normalisation, which Spark lacks, as one Arrow hop over all columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.vocab import MAX_DESCRIPTION, NULL_TOKENS
from leadloom.values import let, one_of

IGNORABLE = "[\\p{Cc}\\p{Cf}\\p{Cs}\\p{Co}\\p{Cn}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Without invisible characters, blanks collapsed, null for the usual "no value" marks."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_col(c), IGNORABLE, ""), "(?U)\\s+", " "))
    return let(t, lambda t: F.when(~one_of(F.lower(t), NULL_TOKENS), t))


def fold_unicode(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """The text columns in compatibility form (full-width letters, ligatures), all in one trip to Python and back."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    shape = "struct<" + ",".join(f"`{c}`:string" for c in columns) + ">"

    @F.pandas_udf(shape)
    def fold(cells: pd.DataFrame) -> pd.DataFrame:
        return cells.apply(lambda s: s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)))

    rest = [c for c in df.columns if c not in columns]
    done = df.select(*rest, fold(F.struct(*columns)).alias("__folded"))
    return done.select(*[F.col(f"__folded.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def slug_of(x: str | None) -> str:
    """Letters and digits of a name in any script, without case, marks and strokes."""
    t = unicodedata.normalize("NFKD", (x or "").casefold())
    return "".join(c for c in t if not unicodedata.combining(c) and c.isalnum()).replace("đ", "d")


@F.pandas_udf(T.StringType())
def unicode_slug(names: pd.Series) -> pd.Series:
    return names.map(slug_of)


def ascii_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]", "")


def titlecase(c: Column) -> Column:
    """Of a clean name: its shouted parts (between blanks, hyphens, apostrophes) in title case, the others as they are."""

    def case(t: Column) -> Column:
        shouted = (F.upper(t) == t) & (F.lower(t) != t)
        return F.when(shouted, F.concat(F.upper(F.substring(t, F.lit(1), F.lit(1))), F.lower(F.substring(t, F.lit(2), F.char_length(t))))).otherwise(t)

    # The marks become parts of their own, so that one pass over the parts does.
    parts = F.split(F.regexp_replace(c, "([ '-])", "\u0001$1\u0001"), "\u0001", -1)
    return F.when(c.isNotNull(), F.array_join(F.transform(parts, case), ""))


def split_name(c: Column) -> tuple[Column, Column]:
    """First and last part of a clean full name."""
    return F.regexp_replace(c, " [^ ]*$", ""), F.when(c.contains(" "), F.substring_index(c, " ", -1))


def join_name(a: Column, b: Column) -> Column:
    return F.nullif(F.concat_ws(" ", a, b), F.lit(""))


EMAIL = "^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$"


def normalize_email(clean: Column) -> Column:
    """The bare lower-case address of a clean cell, or null."""

    def bare(t: Column) -> Column:
        return let(F.regexp_extract(t, "<([^<>@\\s]+@[^<>\\s]+)>", 1), lambda inner: F.when(inner != "", inner).when(~t.rlike("[<>]"), t))

    t = let(F.trim(F.regexp_replace(clean, "(?i)^mailto:", "")), bare)
    return let(F.lower(F.regexp_replace(F.trim(t), "^[.,;:]+|[.,;:]+$", "")), lambda m: F.when(m.rlike(EMAIL), m))


def normalize_phone(clean: Column) -> Column:
    """``+`` and digits of a clean cell; null below seven digits."""

    def number(d: Column) -> Column:
        abroad = clean.startswith("+") | clean.startswith("00") | d.startswith("00")
        rest = F.regexp_replace(d, "^00", "")
        return let(F.when(abroad, F.regexp_replace(rest, "^0+", "")).otherwise(rest), lambda n: F.when(F.length(n) >= 7, F.when(abroad, F.concat(F.lit("+"), n)).otherwise(n)))

    return let(F.regexp_replace(F.regexp_replace(clean, "[^0-9+]", ""), "^\\++", ""), number)


def strip_title_suffix(clean: Column) -> Column:
    return clean_text(F.regexp_replace(clean, "(?i)\\s+(?:at|@)\\s+.+$", ""))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def truncate_description(clean: Column, n: int = MAX_DESCRIPTION) -> Column:
    """Cut at the last blank before ``n`` characters."""
    head = F.substring(clean, 1, n)
    cut = F.regexp_replace(F.regexp_replace(head, " [^ ]*$", ""), "[,;:]+$", "")
    return F.when(F.char_length(clean) > n, F.concat(cut, F.lit("…"))).otherwise(clean)


def titled(c: Column) -> Column:
    """A job title for comparison as a whole: case and blanks apart, punctuation kept."""
    return F.lower(F.trim(F.regexp_replace(c, "(?U)\\s+", " ")))


def excerpt(c: Column, n: int = 300) -> Column:
    return F.substring(F.regexp_replace(c, "(?U)\\s+", " "), 1, n)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
