"""Sources by name: callables that give raw records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Source = Callable[..., DataFrame]
_SOURCES: dict[str, Source] = {}


def register(name: str) -> Callable[[Source], Source]:
    def add(f: Source) -> Source:
        if not name or name in _SOURCES:
            raise ValueError(f"source {name!r} is empty or taken")
        _SOURCES[name] = f
        return f

    return add


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise ValueError(f"no source {name!r}; known are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


@register("csv")
def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    from leadloom.sources import delimited

    return delimited.read(spark, path, **options)


@register("people_pages")
def _people(spark: SparkSession, path: str, **options) -> DataFrame:
    from leadloom.sources import people_pages

    return people_pages.to_raw(people_pages.people(spark.read.text(path, wholetext=True)), **options)


@register("website")
def _website(spark: SparkSession, path: str, **options) -> DataFrame:
    from leadloom.sources import company_pages

    return company_pages.to_raw(spark.read.parquet(path), **options)


@register("synthetic")
def _synthetic(spark: SparkSession, path: str = "", n: int = 100, **options) -> DataFrame:
    from leadloom.sources import synthetic

    return synthetic.generate(spark, int(n), **options)


@register("people_search")
def _people_search(spark: SparkSession, path: str = "", *, settings, criteria: dict, limit: int | None = None, http=None, opener: str = "", **options) -> DataFrame:
    from leadloom.settings import Http
    from leadloom.sources import live, people_pages

    found = people_pages.to_raw(people_pages.people(live.people(spark, settings, criteria, limit, http or Http(), opener)), **options)
    return found if limit is None else found.orderBy("seq").limit(limit)


@register("company_site")
def _company_site(spark: SparkSession, path: str = "", *, settings, limit: int | None = None, http=None, opener: str = "", **options) -> DataFrame:
    from leadloom.settings import Http
    from leadloom.sources import company_pages, live

    return company_pages.to_raw(live.sites(spark, settings, limit, http or Http(), opener), **options)
