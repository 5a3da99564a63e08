"""Facts about companies from web pages: one record per site.

The HTML of a page is parsed in an Arrow UDF (title, meta, JSON-LD, links); everything after it is Column expressions. Pages of a site are folded homepage first: the first
value of each fact, all mailboxes, the first page of each social platform over all pages. A site without any fact gives no record: no name, title, description, mailbox,
social page, contact page, or property of an organisation.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leadloom.functions import text, urls
from leadloom.schema import conform

# Names of meta tags, kinds of organisations, words of contact pages, and titles that name no company.
DESCRIPTIONS = ("og:description", "description", "twitter:description")
SITE_NAMES = ("og:site_name", "application-name")
ORGANISATIONS = ("organization", "corporation", "localbusiness", "ngo", "educationalorganization", "governmentorganization", "medicalorganization", "newsmediaorganization", "onlinebusiness")
CONTACT_WORDS = ("contact", "about", "impressum", "kontakt", "company")
NO_PAGES = ("mailto:", "tel:", "javascript:", "#")
NO_TITLES = ("home", "homepage", "welcome", "index", "start")

_TEXT = ("title", "site_name", "description", "org_name", "org_description", "org_industry", "org_employees", "org_country", "org_city")
FACTS = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXT), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("same_as", "hrefs")), T.StructField("told", T.BooleanType())])


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.hrefs, self.ld = "", [], []
        self.meta: list[tuple[str, str]] = []
        self.inside = ""

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("a", "link") and a.get("href"):
            self.hrefs.append(a["href"])
        elif tag == "meta":
            self.meta.append(((a.get("property") or a.get("name") or "").lower(), a.get("content", "")))
        self.inside = "title" if tag == "title" else "ld" if tag == "script" and a.get("type", "").lower() == "application/ld+json" else self.inside if tag not in ("script", "style") else ""
        if self.inside == "ld" and tag == "script":
            self.ld.append("")

    def handle_endtag(self, tag):
        if tag in ("title", "script", "style"):
            self.inside = ""

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        elif self.inside == "ld" and self.ld:
            self.ld[-1] += data


def _organisations(blocks: list[str]):
    """Organisation objects at any depth, the last ones of a list first."""
    for block in blocks:
        try:
            stack = [json.loads(block)]
        except ValueError:
            continue
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack.extend(x)
            elif isinstance(x, dict):
                kinds = x.get("@type")
                if any(str(k).lower() in ORGANISATIONS for k in (kinds if isinstance(kinds, list) else [kinds])):
                    yield x
                stack.extend(v for v in x.values() if isinstance(v, (dict, list)))


def facts(html: str | None) -> dict:
    """What one page says; never raises."""
    p = _Parser()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # noqa: BLE001
        pass
    out: dict = {"title": p.title.strip() or None, "hrefs": p.hrefs, "same_as": []}
    first = lambda names: next((v for k, v in p.meta if k in names and v.strip()), None)
    out["description"], out["site_name"] = first(DESCRIPTIONS), first(SITE_NAMES)
    for o in _organisations(p.ld):
        place = o.get("address") if isinstance(o.get("address"), dict) else {}
        size = o.get("numberOfEmployees")
        size = size.get("value", size.get("minValue")) if isinstance(size, dict) else size
        country = place.get("addressCountry")
        country = country.get("name") if isinstance(country, dict) else country
        for k, v in (("org_name", o.get("name")), ("org_description", o.get("description")), ("org_industry", o.get("industry")), ("org_employees", size), ("org_country", country), ("org_city", place.get("addressLocality"))):
            if v is not None and not isinstance(v, (dict, list)) and str(v).strip():
                out.setdefault(k, str(v))
        same = o.get("sameAs")
        out["same_as"] += [s for s in (same if isinstance(same, list) else [same]) if isinstance(s, str)]
    out["told"] = any(k.startswith("org_") for k in out) or bool(out["same_as"])
    return {f.name: out.get(f.name) for f in FACTS}


@F.pandas_udf(FACTS)
def page_facts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([facts(x) for x in html], columns=[f.name for f in FACTS])


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolved(base: pd.Series, links: pd.Series) -> pd.Series:
    def go(b, many):
        out = []
        for x in many if many is not None else []:
            try:
                out.append(urljoin(b or "", x))
            except ValueError:
                continue
        return out

    return pd.Series([go(b, x) for b, x in zip(base, links)])


def clean_title(c: Column) -> Column:
    """The first part of a title that names something, else the whole."""
    parts = F.filter(F.split(c, "\\s+[|\\-–—·»:]\\s+|:\\s+"), lambda x: ~F.lower(F.trim(x)).isin(*NO_TITLES) & (F.trim(x) != ""))
    return F.coalesce(F.trim(F.get(parts, F.lit(0))), c)


def mailboxes(hrefs: Column, most: int = 5) -> Column:
    found = F.transform(F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:")), lambda h: text.normalize_email(text.clean_text(F.regexp_replace(h, "\\?.*$", ""))))
    return F.slice(F.array_distinct(F.filter(found, lambda m: m.isNotNull())), 1, most)


def contact_page(page: Column, pages: Column) -> Column:
    """Of the pages (``normalize_page``) that a page links to, the first whose path has the foremost word of contact pages; not the page itself."""

    def ranked(u: Column, i: Column) -> Column:
        path = F.lower(F.regexp_extract(u, "^https://[^/?#]*([^?#]*)", 1))
        return F.struct(F.coalesce(*[F.when(path.contains(w), n) for n, w in enumerate(CONTACT_WORDS)], F.lit(99)).alias("rank"), i.alias("pos"), u.alias("url"))

    return F.array_min(F.filter(F.transform(pages, ranked), lambda s: (s["rank"] < 99) & (s["url"] != page)))["url"]


def host_of(url: str) -> str:
    """The host of an address on the driver or in a reader, without port and www."""
    text = url.strip()
    return urlsplit(text if "://" in text else f"https://{text}").hostname.lower().removeprefix("www.") if text and " " not in text and urlsplit(text if "://" in text else f"https://{text}").hostname else ""


def seed_urls(entries: list[str]) -> list[str]:
    """``https://host`` of each usable entry, the first of each host."""
    hosts = dict.fromkeys(h for e in entries if (h := host_of(e)) and "." in h)
    return [f"https://{h}" for h in hosts]


def next_page(html: str, url: str) -> str | None:
    """The page worth reading after this one: its contact page, as ``contact_page`` finds it."""
    best: tuple[int, str] | None = None
    plain = lambda u: u.split("#")[0].rstrip("/")
    for h in facts(html)["hrefs"]:
        if h.lower().startswith(NO_PAGES):
            continue
        try:
            to = plain(urljoin(url, h))
            path = urlsplit(to).path.lower()
        except ValueError:
            continue
        rank = next((n for n, w in enumerate(CONTACT_WORDS) if w in path), None)
        if rank is not None and to.startswith(("http://", "https://")) and to != plain(url) and (best is None or rank < best[0]):
            best = rank, to
    return best[1] if best else None


def seeds(pages: DataFrame) -> DataFrame:
    """Pages with their site (host), the first page of each address kept."""
    df = pages.withColumn("site", urls.normalize_domain(text.clean_text("url"))).withColumn("page", urls.normalize_page(text.clean_text("url"))).where(F.col("site").isNotNull())
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("site", "page").orderBy("page_id"))).where(F.col("nth") == 1).drop("nth")


def to_raw(pages: DataFrame, provider: str = "website", src_rank: int = 0) -> DataFrame:
    """One raw record per site of (page_id, url, html) with at least one fact."""
    df = seeds(pages).withColumn("f", page_facts("html"))
    base = F.when(F.col("url").rlike("^\\s*[a-zA-Z][a-zA-Z0-9+.-]*://"), F.trim("url")).otherwise(F.concat(F.lit("https://"), F.trim("url")))
    hrefs = F.filter(F.coalesce("f.hrefs", F.array().cast("array<string>")), lambda h: ~F.lower(h).rlike("^(?:" + "|".join(NO_PAGES) + ")"))
    df = df.withColumn("declared", resolved(base, F.coalesce("f.same_as", F.array().cast("array<string>")))).withColumn("links", resolved(base, hrefs))
    df = df.withColumn("pages", F.filter(F.transform("links", lambda u: urls.normalize_page(text.clean_text(u))), lambda u: u.isNotNull()))
    df = df.select(
        "site", "page_id", "page", "f", mailboxes(F.col("f.hrefs")).alias("mails"), urls.social_links(F.concat("declared", "links")).alias("social"), contact_page(F.col("page"), F.col("pages")).alias("contact"),
        F.struct((F.col("page") != F.concat(F.lit("https://"), F.col("site"))).alias("inner"), F.col("page_id")).alias("order"),
    )
    # A platform's first page over all pages of the site: one row a platform, then the least in page order.
    links = df.select("site", "order", F.explode_outer(F.map_entries("social")).alias("s")).where(F.col("s").isNotNull())
    links = links.groupBy("site", F.col("s.key").alias("platform")).agg(F.min_by("s.value", "order").alias("url"))
    links = links.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "url")))).alias("social"))  # no more than there are platforms
    first = lambda c, name: F.min_by(c, F.when(c.isNotNull(), F.col("order"))).alias(name)
    given = lambda c: text.clean_text(F.col(f"f.{c}"))
    site = df.groupBy("site").agg(
        F.min("page_id").alias("seq"), first(given("org_name"), "org_name"), first(given("site_name"), "site_name"), first(given("title"), "title"), first(given("org_description"), "org_description"),
        first(given("description"), "description"), first(given("org_industry"), "industry"), first(given("org_employees"), "employees"), first(given("org_country"), "country"), first(given("org_city"), "city"),
        first(F.get("mails", F.lit(0)), "email"), first(F.col("contact"), "contact"), F.max("f.told").alias("told"),
    )
    site = site.join(links, "site", "left").withColumn("title", clean_title(F.col("title")))
    told = F.coalesce("told", F.lit(False)) | F.coalesce("site_name", "title", "description", "email", "contact").isNotNull() | F.col("social").isNotNull()
    rows = site.where(told).select(
        "seq", F.lit(provider).alias("provider"), F.col("site").alias("external_id"), F.concat(F.lit("https://"), F.col("site")).alias("source_url"), "email", F.coalesce("org_name", "site_name", "title").alias("company_name"),
        F.col("site").alias("company_domain"), F.concat(F.lit("https://"), F.col("site")).alias("company_website"), F.col("industry").alias("company_industry"), F.col("employees").alias("company_employee_count"),
        F.col("country").alias("company_country"), F.col("city").alias("company_city"), F.coalesce("org_description", "description").alias("company_description"), F.col("contact").alias("company_contact_url"),
        F.col("social").alias("company_social_links"),
    )
    return conform(rows, provider, src_rank)


# What names a credential in pages and addresses.
_SECRET_NAME = "(?:[\\w-]*(?:token|secret|passw(?:or)?d|api[_-]?key|apikey|session(?:id)?|sid|auth|csrf|credential|bearer)[\\w-]*)"
_SCRUBS = (
    (f"(?i)(\\b{_SECRET_NAME}[\"']?\\s*[=:]\\s*[\"']?)(?!bearer\\b)[^\"'&\\s<>]{{4,}}", "$1***"),
    (f"(?i)(name=[\"']{_SECRET_NAME}[\"'][^>]*?(?:value|content)=[\"'])[^\"']*", "$1***"),
    (f"(?i)((?:value|content)=[\"'])[^\"']*([\"'][^>]*?name=[\"']{_SECRET_NAME}[\"'])", "$1***$2"),
    ("(?i)(bearer\\s+)[\\w.~+/=-]{8,}", "$1***"),
    ("(?i)(\\w+://)[^/@\\s\"']+:[^/@\\s\"']+@", "$1***@"),
    ("\\beyJ[\\w-]{8,}\\.[\\w-]{8,}\\.[\\w-]*", "***"),
)


def scrub(html: Column) -> Column:
    """HTML or an address without credentials: values of secret-looking parameters, attributes and fields, bearer and JSON web tokens, and passwords in addresses become ``***``."""
    for pattern, by in _SCRUBS:
        html = F.regexp_replace(html, pattern, by)
    return html


def leaks(html: Column, values: list[str] = ()) -> Column:
    """Whether something that looks like a credential, or one of ``values``, is left: such a text must not be written."""
    found = F.coalesce(html.rlike("(?i)bearer\\s+[\\w.~+/=-]{8,}|\\beyJ[\\w-]{8,}\\.[\\w-]{8,}\\."), F.lit(False))
    for v in values:
        found = found | F.coalesce(html.contains(v), F.lit(False))
    return found
