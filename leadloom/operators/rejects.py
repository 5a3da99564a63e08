"""Delimited records that fail to parse, apart from those that load.

``parse`` reads one record per row with the delimiter of its own file. ``failures`` explodes the
cells into (row, column, value), joins the rule table on the column, evaluates the rule of each
cell and gives one row per record and reason. ``load`` is the anti-join of the records with those.

Defined results: header rows (``line_no`` 1) and blank or null lines are no records; a file
without a header is read with commas; a cell that is missing (blank or a placeholder) passes every rule;
reasons of a repeated ``line_id`` come out once; columns of the input beyond the four named are ignored.
Everything but the header lookup is row-local, so a file holding most rows makes no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import BROADCAST_ROWS, small
from leadloom.functions.numbers import parse_employee_count, plausible
from leadloom.values import let, present

# The columns of the layout, in order.
LAYOUT = (
    "First Name", "Last Name", "Position", "Email Address", "Direct Phone", "LinkedIn Profile",
    "Company", "Website", "Industry", "Employees", "Country", "City",
)

#: Column of the layout, reason, how it is judged.
RULES = (("Employees", "employees", "headcount"), ("Email Address", "email", "address"), ("Direct Phone", "phone", "phone"))

ADDRESS = "[^@\\s<>,;]+@[^@\\s.<>,;]+(?:\\.[^@\\s.<>,;]+)+"
#: A private-use character, which no delimiter is.
_CELL_END = "\uE000"


def delimiters(lines: DataFrame) -> DataFrame:
    """(file_name, delimiter) of each file, from its header."""
    mark = F.regexp_extract("line", '(?i)First Name"?([,;\\t|])"?Last Name', 1)
    head = lines.where((F.col("line_no") == 1) & F.col("file_name").isNotNull())
    return head.groupBy("file_name").agg(F.max(F.when(mark != "", mark)).alias("delimiter"))


def cells_of(line: Column, d: Column) -> Column:
    """struct<quoting_ok, cells> of a record's text with the delimiter ``d``.

    A line cut at its quote marks alternates between text outside and inside quotes. It keeps the CSV
    rules exactly if the marks pair up, an opening one follows a delimiter or the start, and a closing one
    precedes a delimiter, the end, or (nothing between) the second mark of an escaped quote.
    """
    opens = lambda s: (s == "") | F.endswith(s, d)
    closes = lambda s: (s == "") | F.startswith(s, d)

    def read(seg: Column) -> Column:
        last = F.size(seg) - 1
        right = F.transform(
            seg,
            lambda s, i: F.when((i % 2 == 1) | (last == 0), True).when(i == 0, opens(s)).when(i == last, closes(s)).otherwise((s == "") | (F.startswith(s, d) & F.endswith(s, d))),
        )
        joined = F.transform(seg, lambda s, i: F.when(i % 2 == 1, s).when((s == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(s, d, F.lit(_CELL_END))))
        return F.struct(((last % 2 == 0) & F.forall(right, lambda x: x)).alias("quoting_ok"), F.split(F.array_join(joined, ""), _CELL_END, -1).alias("cells"))

    # The segments are bound once: copied into the lambdas, they would be cut anew for each of them.
    return let(F.split(F.regexp_replace(line, "\\r?\\n$", ""), '"', -1), read)


def parse(lines: DataFrame) -> DataFrame:
    """(line_id, quoting_ok, cells) of every record."""
    files = small(delimiters(lines), BROADCAST_ROWS)
    body = lines.where((F.coalesce(F.col("line_no"), F.lit(0)) != 1) & (F.coalesce(present_line("line"), F.lit("")) != ""))
    body = body.select("line_id", "file_name", "line").join(files, "file_name", "left")
    shaped = body.select("line_id", cells_of(F.col("line"), F.coalesce("delimiter", F.lit(","))).alias("s"))
    return shaped.select("line_id", "s.quoting_ok", "s.cells")


def present_line(c: str) -> Column:
    return F.trim(F.regexp_replace(c, "[\\s\\u00A0\\u200B\\uFEFF]+", " "))


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(LAYOUT.index(c), r, k) for c, r, k in RULES], "pos int, reason string, kind string")


def breaks_rule(kind: Column, value: Column) -> Column:
    """Whether a cell that is not missing fails its rule."""
    digits = F.length(F.regexp_replace(value, "[^\\p{Nd}]", ""))
    return (
        F.when(kind == "headcount", plausible(parse_employee_count(value)).isNull())
        .when(kind == "address", ~value.rlike(f"(?i)^(?:(?:mailto:)?\\s*{ADDRESS}|[^<>@]*<\\s*(?:mailto:)?{ADDRESS}\\s*>)$"))
        .when(kind == "phone", (digits < 7) | value.rlike("\\p{L}"))
        .otherwise(False)
    )


def failures(lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(line_id, reason), one row for each reason for which a record fails."""
    parsed = parse(lines) if parsed is None else parsed
    shape = parsed.select(
        "line_id",
        F.when(~F.col("quoting_ok"), "quoting").when(F.size("cells") != len(LAYOUT), "column_count").alias("reason"),
        "cells",
    )
    cells = shape.where(F.col("reason").isNull()).select("line_id", F.posexplode("cells").alias("pos", "value"))
    judged = cells.join(F.broadcast(rule_table(lines.sparkSession)), "pos")  # the rule table is fixed
    value = present("value")
    bad = judged.where(value.isNotNull() & breaks_rule(F.col("kind"), value)).select("line_id", "reason")
    return shape.where(F.col("reason").isNotNull()).select("line_id", "reason").unionByName(bad).distinct()


def load(lines: DataFrame) -> DataFrame:
    """The records without a failure, one string column per column of the layout."""
    parsed = parse(lines)
    clean = parsed.join(failures(lines, parsed).select("line_id").distinct(), "line_id", "left_anti")
    name = lambda c: c.lower().replace(" ", "_")
    return clean.select("line_id", *[F.get("cells", F.lit(i)).alias(name(c)) for i, c in enumerate(LAYOUT)])
