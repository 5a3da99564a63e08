"""Column helpers for cells typed by people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that count as a missing cell.
PLACEHOLDERS = ("", "n/a", "-", "none", "null", "unknown")

#: White space and invisible characters at either end of a cell.
EDGE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


#: White space as ``str.strip`` takes it.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def sql_text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(c: Column, values) -> Column:
    """Whether ``c`` is one of fixed values, as one literal instead of one expression for each."""
    return F.array_contains(F.expr("array(" + ", ".join(map(sql_text, values)) + ")"), c)


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """The value that a fixed table has for ``c``, else null."""
    return F.try_element_at(F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items()) + ")"), c)


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once: in a plain expression tree every use of it would be a copy, and copies of copies grow without end."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(EDGE))


def stripped(c: Column) -> Column:
    """The cell without white space at its ends, or null where nothing is left."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def present(c: Column | str) -> Column:
    """The trimmed cell, or null where it is blank or a placeholder in any case."""
    t = trimmed(c)  # two copies that compile are cheaper here than one that is interpreted
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)
