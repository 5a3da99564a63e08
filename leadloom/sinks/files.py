"""Standardized records as CSV, JSON and JSON Lines, and the report of a run."""

from __future__ import annotations

import csv
import json
import os
import re
import tempfile
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.schema import COMPANY, PERSON

BOM = "﻿"


def iso(c: Column) -> Column:
    """UTC with ``Z``, the fraction left out where it is zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def render_links(c: Column) -> Column:
    """``platform=url; platform=url`` in the order of the platforms."""
    t = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return F.when(t != "", t)


def flatten(std: DataFrame) -> DataFrame:
    """The export columns, in order."""
    person = [F.col(f"person.{f}").alias(f"person_{f}") for f in PERSON]
    company = [(render_links(F.col("company.social_links")) if f == "social_links" else F.col(f"company.{f}")).alias(f"company_{f}") for f in COMPANY]
    sources = F.array_join("source.sources", "; ")
    return std.select(
        "lead_id", *person, *company, F.col("source.provider").alias("source_provider"), F.col("source.external_id").alias("source_external_id"), F.col("source.source_url").alias("source_url"),
        F.when(sources != "", sources).alias("sources"), iso(F.col("source.collected_at")).alias("collected_at"), "completeness",
    )


def publish(path: Path, write: Callable) -> None:
    """Write beside ``path`` and rename, so that nobody sees half a file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            write(f)
        os.chmod(name, 0o644)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_csv(std: DataFrame, path: str | Path) -> int:
    """One file with a byte order mark and a header; rows come to the driver partition by partition. For large results use ``flatten(...).write.csv``."""
    flat = flatten(std)
    n = 0

    def write(f) -> None:
        nonlocal n
        f.write(BOM)
        w = csv.writer(f, lineterminator="\n")
        w.writerow(flat.columns)
        for row in flat.toLocalIterator():
            w.writerow(["" if v is None else v for v in row])
            n += 1

    publish(Path(path), write)
    return n


def _documents(std: DataFrame) -> DataFrame:
    source = F.col("source").withField("collected_at", iso(F.col("source.collected_at")))
    keep = [c for c in ("lead_id", "person", "company", "source", "normalization_issues", "completeness") if c in std.columns]
    return std.select(F.to_json(F.struct(*[source.alias("source") if c == "source" else F.col(c) for c in keep]), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(std: DataFrame, path: str | Path) -> int:
    n = 0

    def write(f) -> None:
        nonlocal n
        for row in _documents(std).toLocalIterator():
            f.write(row[0] + "\n")
            n += 1

    publish(Path(path), write)
    return n


def write_json(std: DataFrame, path: str | Path) -> int:
    """One indented array."""
    n = 0

    def write(f) -> None:
        nonlocal n
        for row in _documents(std).toLocalIterator():
            f.write(("[\n" if n == 0 else ",\n") + "\n".join("  " + x for x in json.dumps(json.loads(row[0]), ensure_ascii=False, indent=2).split("\n")))
            n += 1
        f.write("\n]\n" if n else "[]\n")

    publish(Path(path), write)
    return n


FORMATS: dict[str, tuple[str, Callable]] = {"csv": (".csv", write_csv), "json": (".json", write_json), "jsonl": (".jsonl", write_jsonl)}


def register(name: str, ending: str, writer: Callable) -> None:
    if not name or name in FORMATS:
        raise ValueError(f"format {name!r} is empty or taken")
    FORMATS[name] = (ending, writer)


def file_name(prefix: str, sources: list[str], at: datetime, ending: str) -> str:
    slug = "-".join(sorted({re.sub("[^a-z0-9]+", "-", s.lower()).strip("-") for s in sources} - {""})) or "all"
    return f"{prefix}_{slug}_{at:%Y%m%dT%H%M%SZ}{ending}"


def export(std: DataFrame, folder: str | Path, formats: list[str], prefix: str, sources: list[str], at: datetime) -> list[dict]:
    """Every format is tried; the first error is raised at the end."""
    done, error = [], None
    for name in dict.fromkeys(formats):
        ending, writer = FORMATS[name]
        path = Path(folder) / file_name(prefix, sources, at, ending)
        try:
            done.append({"format": name, "path": str(path), "records": writer(std, path), "bytes": path.stat().st_size})
        except Exception as e:  # noqa: BLE001
            error = error or e
    if error:
        raise error
    return done


def write_report(report: dict, path: str | Path) -> None:
    publish(Path(path), lambda f: f.write(json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n"))
