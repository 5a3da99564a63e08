"""Python data sources that fetch: pages of a people search, and pages of company sites. What they give is what the stored-page sources read.

``people_search`` gives (page_no, value); its partitions are ranges of pages, read in order until a page is short or empty. ``company_site`` gives (page_id, url, html);
its partitions are sites, so one host's pages are read by one task, which keeps its waits. Options are strings; ``opener`` names an importable function
``module:function`` that answers requests instead of the network.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leadloom.errors import BadConfig, Denied, SourceFailure
from leadloom.settings import Http, PeopleSearch, Website
from leadloom.sources import fetch, people_pages

PAGES_DDL = "page_no bigint, value string"
SITES_DDL = "page_id bigint, url string, html string"
#: Pages of a site lie within so many numbers of each other.
PER_SITE = 1_000


def _client(options: dict, source: str, base: str = "", headers: dict | None = None) -> fetch.Client:
    client = fetch.Client(source, base, headers or {}, Http(**json.loads(options.get("http", "{}"))))
    if options.get("opener"):
        module, _, name = options["opener"].partition(":")
        client.opener = getattr(importlib.import_module(module), name)
    return client


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PeopleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.criteria = json.loads(options.get("criteria", "{}"))
        self.limit = int(options.get("limit", 0)) or None
        self.per_page = min(int(options.get("per_page", 25)), people_pages.MAX_PER_PAGE, self.limit or people_pages.MAX_PER_PAGE)
        pages = int(options.get("max_pages", 20))
        # No more pages than the limit needs.
        self.pages = pages if self.limit is None else min(pages, -(-self.limit // self.per_page))
        if not options.get("api_key"):
            raise Denied("people_search", "no key is configured")

    def partitions(self) -> list[PageRange]:
        step = max(1, int(self.options.get("pages_per_task", self.pages)))
        return [PageRange(a, min(self.pages, a + step - 1)) for a in range(1, self.pages + 1, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        client = _client(self.options, "people_search", self.options.get("base_url", ""), {"Content-Type": "application/json", "X-Api-Key": self.options["api_key"]})
        for page in range(partition.first, partition.last + 1):
            answer = client.json("POST", "/mixed_people/search", people_pages.request(self.criteria, page, self.per_page))
            found = people_pages.entries(answer)
            if found:
                yield page, json.dumps({"people": found}, ensure_ascii=False)
            if len(found) < self.per_page:
                return


class PeopleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "people_search"

    def schema(self) -> str:
        return PAGES_DDL

    def reader(self, schema) -> PeopleReader:
        return PeopleReader(self.options)


class Site(InputPartition):
    def __init__(self, number: int, seed: str):
        self.number, self.seed = number, seed


class SiteReader(DataSourceReader):
    def __init__(self, options: dict):
        from leadloom.sources.company_pages import seed_urls

        self.options = dict(options)
        self.site = Website(**json.loads(options.get("website", "{}")))
        limit = int(options.get("limit", 0)) or None
        self.seeds = seed_urls(json.loads(options.get("urls", "[]")))[:limit]
        if not self.seeds:
            raise SourceFailure("company_site", "no usable address is configured")

    def partitions(self) -> list[Site]:
        return [Site(i, s) for i, s in enumerate(self.seeds)]

    def read(self, partition: Site) -> Iterator[tuple]:
        from leadloom.sources.company_pages import host_of, next_page

        manners = fetch.Manners(_client(self.options, "company_site", headers={"User-Agent": self.site.user_agent}), self.site.user_agent, self.site.request_delay, self.site.respect_robots)
        todo, seen, read = [partition.seed], set(), 0
        while todo and read < self.site.max_pages_per_site:
            url = todo.pop(0)
            if url in seen:
                continue
            seen.add(url)
            if not manners.allowed(url):
                continue
            try:
                html = manners.get(url)
            except SourceFailure:
                # A site whose home page can't be read gives no page; another missing page is usual.
                if url == partition.seed:
                    return
                html = None
            read += 1
            if html is None:
                continue
            yield partition.number * PER_SITE + read, url, html
            follow = next_page(html, url)
            if follow and not (self.site.same_host_only and host_of(follow) != host_of(partition.seed)):
                todo.append(follow)


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "company_site"

    def schema(self) -> str:
        return SITES_DDL

    def reader(self, schema) -> SiteReader:
        return SiteReader(self.options)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(PeopleSource)
    spark.dataSource.register(SiteSource)


def people(spark: SparkSession, settings: PeopleSearch, criteria: dict, limit: int | None = None, http: Http = Http(), opener: str = "", pages_per_task: int | None = None) -> DataFrame:
    """(page_no, value) of the search's pages."""
    if not settings.api_key:
        raise Denied("people_search", "no key is configured")
    _register(spark)
    options = {"criteria": json.dumps(criteria), "per_page": settings.per_page, "max_pages": settings.max_pages, "base_url": settings.base_url, "api_key": str.__str__(settings.api_key), "http": json.dumps(vars(http)), "opener": opener, "limit": limit or 0}
    if pages_per_task:
        options["pages_per_task"] = pages_per_task
    return spark.read.format("people_search").options(**options).load()


def sites(spark: SparkSession, settings: Website, limit: int | None = None, http: Http = Http(), opener: str = "") -> DataFrame:
    """(page_id, url, html) of the pages of the configured sites."""
    if not settings.urls:
        raise BadConfig("no company site is configured")
    _register(spark)
    return spark.read.format("company_site").options(urls=json.dumps(settings.urls), website=json.dumps(vars(replace(settings, urls=()))), http=json.dumps(vars(http)), opener=opener, limit=limit or 0).load()
