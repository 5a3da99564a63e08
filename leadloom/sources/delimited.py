"""Delimited files: delimiter from the head of the file, columns from a table of header spellings.

A line is a record, so that a file is read by as many tasks as it has splits, and a quote that is never closed spoils its own line only. Such lines are no records:
``rejected`` has them with the reason (a scan in one process would stop there, or take the rest of the file for one cell). Short records are filled up with nulls, and
cells beyond the header are left out. Files whose cells hold line breaks are read with ``multi_line``, one task a file.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.cluster import cut, small
from leadloom.functions.vocab import HEADERS
from leadloom.operators.rejects import cells_of
from leadloom.schema import conform
from leadloom.values import stripped

DELIMITERS = ",;\t|"
SNIFF = 8_192


def plain_header(h: str) -> str:
    return re.sub("[^a-z0-9]+", "", h.strip().casefold())


KNOWN = {plain_header(a): target for target, spellings in HEADERS.items() for a in spellings}


def sniff(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head[:SNIFF], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def parse_map(entries: list[str]) -> dict[str, str]:
    """``target=Source Header`` entries as plain header -> target."""
    out = {}
    for e in entries:
        target, mark, header = (x.strip() for x in e.partition("="))
        if not mark or not target or not header:
            raise ValueError(f"invalid column map entry {e!r}; expected 'target=Source Header'")
        if target not in HEADERS:
            raise ValueError(f"{target!r} is no known column; known are {', '.join(HEADERS)}")
        out[plain_header(header)] = target
    return out


def targets(headers: list[str], column_map: list[str] = ()) -> dict[str, str]:
    """Target -> header; the first header that claims a target has it."""
    known = KNOWN | parse_map(list(column_map))
    out: dict[str, str] = {}
    for h in headers:
        if (t := known.get(plain_header(h))) and t not in out:
            out[t] = h
    return out


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, n, line) of the lines that are not empty, ``n`` numbering them within a task."""
    # A reader of one column that knows neither delimiters nor quotes: decoded lines.
    text = spark.read.csv(path, schema="line string", sep="\ue001", quote="", encoding=encoding, header=False)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("line", "^\ufeff", "").alias("line")).where(F.col("line") != "")


def numbered(text: DataFrame) -> DataFrame:
    """Adds ``row`` (1 for the line behind the header of its file) to ``lines``: from the counts of the splits before, one row a split, without moving a line."""
    blocks = text.groupBy("file", "block").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cut(blocks.select("file", "block", "first", before.alias("before")))
    return text.join(small(blocks), ["file", "block"]).withColumn("row", F.col("before") + F.col("n") - F.col("first")).drop("first", "before")


def head(text: DataFrame) -> str:
    """The first lines of the first file, as far as the sniffer looks."""
    out, size = [], 0
    for r in text.select("line").limit(200).collect():
        out.append(r["line"])
        size += len(r["line"]) + 1
        if size >= SNIFF:
            break
    return "\n".join(out)


def _parsed(spark: SparkSession, path: str, delimiter: str, encoding: str) -> tuple[DataFrame, list[str]]:
    text = lines(spark, path, encoding)
    top = head(text)
    if not top:
        return text.select(F.lit(0).alias("row"), "n", "line", F.lit(True).alias("quoting_ok"), F.array("line").alias("cells")).limit(0), []
    d = sniff(top) if delimiter == "auto" else delimiter
    first = top.split("\n")[0]
    body = numbered(text).where(F.col("line") != F.lit(first))  # the header of each file
    return body.select("row", "n", "line", cells_of(F.col("line"), F.lit(d)).alias("s")).select("row", "n", "line", "s.quoting_ok", "s.cells"), next(csv.reader([first], delimiter=d))


def rejected(spark: SparkSession, path: str, delimiter: str = "auto", encoding: str = "UTF-8") -> DataFrame:
    """(row, line, reason) of the lines that are no records."""
    return _parsed(spark, path, delimiter, encoding)[0].where(~F.col("quoting_ok")).select("row", "line", F.lit("quoting").alias("reason"))


def _whole_file(spark: SparkSession, path: str, delimiter: str, encoding: str) -> tuple[DataFrame, list[str]]:
    d = sniff(head(lines(spark, path, encoding))) if delimiter == "auto" else delimiter
    df = spark.read.csv(path, header=True, sep=d, encoding=encoding, multiLine=True, inferSchema=False, mode="PERMISSIVE", quote='"', escape='"')
    cells = F.array(*[F.col(f"`{c}`") for c in df.columns])
    return df.select((F.monotonically_increasing_id() + 1).alias("row"), F.monotonically_increasing_id().alias("n"), cells.alias("cells")), df.columns


def read(spark: SparkSession, path: str, provider: str = "csv", delimiter: str = "auto", encoding: str = "UTF-8", column_map: list[str] = (), src_rank: int = 0, multi_line: bool = False, limit: int | None = None) -> DataFrame:
    """Raw records of a delimited file, in file order; ``limit`` counts records, not lines."""
    if multi_line:
        found, headers = _whole_file(spark, path, delimiter, encoding)
    else:
        found, headers = _parsed(spark, path, delimiter, encoding)
        found = found.where("quoting_ok")
    claimed = targets(headers, list(column_map))
    at = {h: i for i, h in reversed(list(enumerate(headers)))}
    cell = lambda i: F.get("cells", F.lit(i))
    whole = F.to_json(F.struct(*[cell(i).alias(h or f"_{i}") for h, i in at.items()], F.col("row").alias("_row_number")))
    rows = found.select((F.col("n") + 1).alias("seq"), *[stripped(cell(at[h])).alias(t) for t, h in claimed.items()], whole.alias("raw"))
    rows = rows.where(F.coalesce(*[F.col(t) for t in claimed]).isNotNull()) if claimed else rows.limit(0)
    rows = rows if limit is None else rows.orderBy("seq").limit(limit)
    return conform(rows.withColumn("provider", F.lit(provider)), provider, src_rank)
