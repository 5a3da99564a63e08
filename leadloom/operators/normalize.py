"""Raw records to standardized ones, row by row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import labels, numbers, text, urls
from leadloom.functions.vocab import MAX_ISSUE_VALUE, POINTS
from leadloom.schema import TEXT


def _clean(raw: DataFrame, unicode: bool) -> DataFrame:
    """The text columns cleaned, once, before anything is derived from them."""
    raw = text.fold_unicode(raw, TEXT) if unicode else raw
    return raw.select(*[text.clean_text(c).alias(c) if c in TEXT else F.col(c) for c in raw.columns])


def issues(c: dict[str, Column]) -> Column:
    """What a source sent and could not be used."""
    found = [
        ("email", "invalid_email", c["email"], text.normalize_email(c["email"])),
        ("linkedin_url", "malformed_url", c["linkedin_url"], urls.normalize_profile(c["linkedin_url"])),
        ("company_domain", "invalid_domain", c["company_domain"], urls.normalize_domain(c["company_domain"])),
        ("company_website", "malformed_url", c["company_website"], urls.normalize_domain(c["company_website"])),
        ("company_contact_url", "malformed_url", c["company_contact_url"], urls.normalize_page(c["company_contact_url"])),
    ]
    rows = [F.when(v.isNotNull() & good.isNull(), F.struct(F.lit(r).alias("rule"), F.lit(f).alias("field"), text.truncate(v, MAX_ISSUE_VALUE).alias("value"))) for f, r, v, good in found]
    return F.array_compact(F.array(*rows))


def completeness(person: Column, company: Column) -> Column:
    points = [F.when(person[k].isNotNull() if k in ("email", "full_name", "job_title", "linkedin_url", "phone") else company[k].isNotNull(), n).otherwise(0) for k, n in POINTS.items()]
    return sum(points[1:], points[0]) / F.lit(100.0)


def identity_keys(slug=text.ascii_slug) -> Column:
    """array<struct<name, value>> of the keys a standardized record has, strongest first."""
    p, c, s = F.col("person"), F.col("company"), F.col("source")
    name, firm = slug(p["full_name"]), slug(c["name"])
    named = (p["full_name"].isNotNull()) & (name != "")
    key = lambda n, ok, v: F.when(ok, F.struct(F.lit(n).alias("name"), v.alias("value")))
    return F.array_compact(F.array(
        key("source_id", s["external_id"].isNotNull(), F.concat_ws(":", s["provider"], s["external_id"])),
        key("email", p["email"].isNotNull(), p["email"]),
        key("linkedin", p["linkedin_url"].isNotNull(), p["linkedin_url"]),
        key("phone_name", named & p["phone"].isNotNull(), F.concat_ws("|", p["phone"], name)),
        key("name_domain", named & c["domain"].isNotNull(), F.concat_ws("@", name, c["domain"])),
        key("name_company", named & c["name"].isNotNull(), F.concat(name, F.lit("@"), firm)),
    ))


def lead_id(keys: Column) -> Column:
    """Sixteen hexadecimal digits of the hash of provider and strongest personal key."""
    own = F.get(F.filter(keys, lambda k: k["name"] != "source_id"), F.lit(0))["value"]
    rest = F.concat_ws("|", F.col("person.full_name"), F.col("company.name"), F.col("source.external_id"))
    return F.substring(F.sha2(F.concat_ws(":", F.col("source.provider"), F.coalesce(own, rest)), 256), 1, 16)


def normalize(raw: DataFrame, unicode: bool = True) -> DataFrame:
    """src_rank, seq and the standardized record of every raw row. ``unicode``: also fold compatibility forms (one Arrow hop)."""
    slug = text.unicode_slug if unicode else text.ascii_slug
    called = label(F.col("email"), F.col("full_name"), F.col("linkedin_url"), F.col("external_id"))
    df = _clean(raw.withColumn("label", called), unicode)
    c = {x: F.col(x) for x in df.columns}
    # Step by step, so that no expression is copied into the next ones.
    df = df.select(
        "*", issues(c).alias("normalization_issues"), text.titlecase(c["first_name"]).alias("p_first"), text.titlecase(c["last_name"]).alias("p_last"), text.titlecase(c["full_name"]).alias("p_full"),
        text.strip_title_suffix(c["job_title"]).alias("p_title"), text.normalize_email(c["email"]).alias("p_email"), text.normalize_phone(c["phone"]).alias("p_phone"),
        urls.normalize_profile(c["linkedin_url"], "person").alias("p_page"), urls.normalize_domain(c["company_domain"]).alias("c_domain"), urls.normalize_domain(c["company_website"]).alias("c_site"),
        urls.social_links(F.map_values("company_social_links")).alias("c_social"), numbers.plausible(numbers.parse_employee_count(c["company_employee_count"])).alias("c_size"),
    )
    first, last = text.split_name(F.col("p_full"))
    some = F.col("p_full").isNotNull()
    mail_host = F.when(~urls.is_free_mail(F.col("p_email")), urls.email_domain(F.col("p_email")))
    df = df.withColumns({
        "d_first": F.coalesce("p_first", F.when(some & (F.col("p_first").isNull() | F.col("p_last").isNull()), first)),
        "d_last": F.coalesce("p_last", F.when(some & (F.col("p_first").isNull() | F.col("p_last").isNull()), last)),
        "d_full": F.coalesce("p_full", text.join_name(F.col("p_first"), F.col("p_last"))),
        "d_level": F.coalesce(F.nullif(labels.coerce_seniority(F.col("seniority")), F.lit("unknown")), labels.infer_seniority(F.col("p_title"))),
        "d_domain": F.coalesce("c_domain", "c_site", mail_host),
    })
    person = F.struct(
        F.col("d_first").alias("first_name"), F.col("d_last").alias("last_name"), F.col("d_full").alias("full_name"), F.col("p_title").alias("job_title"),
        F.when(F.col("job_title") != F.coalesce("p_title", F.lit("")), F.col("job_title")).alias("job_title_raw"), F.col("d_level").alias("seniority"), F.col("p_email").alias("email"),
        F.col("p_phone").alias("phone"), F.col("p_page").alias("linkedin_url"),
    )
    company = F.struct(
        text.titlecase(F.col("company_name")).alias("name"), F.col("d_domain").alias("domain"), urls.website_of(F.coalesce("c_site", "d_domain")).alias("website"),
        F.col("company_industry").alias("industry"), F.col("c_size").alias("employee_count"), labels.normalize_country(F.col("company_country")).alias("country"),
        text.titlecase(F.col("company_city")).alias("city"), F.coalesce(urls.normalize_profile(F.col("company_linkedin_url"), "company"), F.try_element_at("c_social", F.lit("linkedin"))).alias("linkedin_url"),
        text.truncate_description(F.col("company_description")).alias("description"), urls.normalize_page(F.col("company_contact_url")).alias("contact_url"), F.col("c_social").alias("social_links"),
    )
    provider = F.coalesce("provider", F.lit("unknown"))
    source = F.struct(provider.alias("provider"), "external_id", "source_url", F.col("collected_at").cast("timestamp").alias("collected_at"), F.array(provider).alias("sources"))
    # Bound as a whole: else the optimizer copies each field's derivation to wherever it is read, and into every filter that it pushes down.
    whole = lambda s: F.when(F.rand(0) >= 0, s)  # noqa: E731  (always, which the optimizer can't know)
    std = df.select("src_rank", "seq", whole(person).alias("person"), whole(company).alias("company"), whole(source).alias("source"), "normalization_issues", "label")
    std = std.withColumn("completeness", completeness(F.col("person"), F.col("company"))).withColumn("identity_keys", identity_keys(slug))
    return std.withColumn("lead_id", lead_id(F.col("identity_keys")))


def label(email: Column, full_name: Column, page: Column, external_id: Column) -> Column:
    """How a record is called in a report."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (email, full_name, page, external_id)], F.lit("<unidentified>"))


def is_empty(df: DataFrame, path: str) -> Column:
    """Whether the field at a dotted path has no value: null, blank, empty collection, unknown seniority; 0 and false are values."""
    field = df.schema
    for step in path.split("."):
        names = getattr(field, "names", [])
        if step not in names:
            raise ValueError(f"no such field: {path}")
        field = field[step].dataType
    c = F.col(path)
    kind = field.typeName()
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    if kind == "string":
        return c.isNull() | (F.trim(c) == "") | ((c == "unknown") if path.endswith("seniority") else F.lit(False))
    return c.isNull()
