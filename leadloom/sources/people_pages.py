"""Saved pages of a people search service (JSON), decoded and mapped to raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.errors import SourceFailure
from leadloom.schema import conform
from leadloom.values import stripped

PERSON_DDL = """struct<id:string,first_name:string,last_name:string,name:string,title:string,seniority:string,email:string,linkedin_url:string,sanitized_phone:string,
 phone_numbers:array<struct<sanitized_number:string,raw_number:string,number:string>>,
 organization:struct<name:string,primary_domain:string,domain:string,website_url:string,industry:string,estimated_num_employees:string,country:string,city:string,linkedin_url:string>>"""
PAGE_DDL = f"people array<{PERSON_DDL}>, contacts array<{PERSON_DDL}>"
MAX_PER_PAGE = 100


def request(criteria: dict, page: int, per_page: int, limit: int | None = None) -> dict:
    """The body of a page request: only what is set, similar titles only beside titles."""
    body = {k: v for k, v in criteria.items() if v not in (None, "", [], (), {})}
    if "person_titles" not in body:
        body.pop("include_similar_titles", None)
    return body | {"page": page, "per_page": min(per_page, MAX_PER_PAGE, limit or MAX_PER_PAGE)}


def entries(answer) -> list[dict]:
    """The person objects of a decoded answer; one that is no object is the source's failure."""
    if not isinstance(answer, dict):
        raise SourceFailure("people_search", f"an object was expected, not {type(answer).__name__}")
    found = answer.get("people") or answer.get("contacts") or []
    if not isinstance(found, list):
        raise SourceFailure("people_search", "its people are no list")
    return [p for p in found if isinstance(p, dict)]


def people(pages: DataFrame, column: str = "value") -> DataFrame:
    """(page_no, position, person) of every person on pages of JSON text; entries that are no objects are dropped. A page that is no object fails the source."""
    text = F.trim(F.col(column))
    checked = F.when(text.startswith("{"), text).when(text != "", F.raise_error(F.lit("people_search: an object was expected")).cast("string"))
    page = F.from_json(checked, PAGE_DDL)
    listed = F.when(F.size(page["people"]) > 0, page["people"]).otherwise(page["contacts"])
    number = F.col("page_no") if "page_no" in pages.columns else F.monotonically_increasing_id()
    return pages.select(number.alias("page_no"), F.posexplode(listed).alias("position", "person")).where(F.col("person").isNotNull())


def to_raw(found: DataFrame, provider: str = "people_search", profile_url: str = "https://people.example/people/", src_rank: int = 0) -> DataFrame:
    p = F.col("person")
    o = p["organization"]
    text = stripped
    number = F.filter(F.transform(F.coalesce(p["phone_numbers"], F.array()), lambda x: F.coalesce(text(x["sanitized_number"]), text(x["raw_number"]), text(x["number"]))), lambda x: x.isNotNull())
    # Pages numbered by Spark come as (partition << 33) + row: both are packed more closely, with room for 2 ** 20 people a page.
    packed = F.shiftright(F.col("page_no"), 33) * (1 << 22) + F.col("page_no").bitwiseAND((1 << 33) - 1)
    ordinal = (packed * (1 << 20) + F.col("position") + 1).cast("long")
    rows = found.select(
        ordinal.alias("seq"), F.lit(provider).alias("provider"), text(p["id"]).alias("external_id"),
        F.when(text(p["id"]).isNotNull(), F.concat(F.lit(profile_url), text(p["id"]))).alias("source_url"), text(p["first_name"]).alias("first_name"), text(p["last_name"]).alias("last_name"),
        text(p["name"]).alias("full_name"), text(p["title"]).alias("job_title"), text(p["seniority"]).alias("seniority"), text(p["email"]).alias("email"),
        F.coalesce(text(p["sanitized_phone"]), F.get(number, F.lit(0))).alias("phone"), text(p["linkedin_url"]).alias("linkedin_url"), text(o["name"]).alias("company_name"),
        F.coalesce(text(o["primary_domain"]), text(o["domain"])).alias("company_domain"), text(o["website_url"]).alias("company_website"), text(o["industry"]).alias("company_industry"),
        text(o["estimated_num_employees"]).alias("company_employee_count"), text(o["country"]).alias("company_country"), text(o["city"]).alias("company_city"),
        text(o["linkedin_url"]).alias("company_linkedin_url"), F.to_json(p).alias("raw"),
    )
    return conform(rows, provider, src_rank)
