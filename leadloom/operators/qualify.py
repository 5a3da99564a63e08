"""Declared predicates over standardized records; the first that fails is kept with the record."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.labels import country_is
from leadloom.functions.text import any_of, titled
from leadloom.functions.urls import email_domain, is_free_mail, within
from leadloom.functions.vocab import ROLE_PREFIXES
from leadloom.operators.normalize import is_empty
from leadloom.values import one_of


@dataclass(frozen=True)
class Rules:
    """What records have to be like. Unknown values fail lists of what is included, and pass lists of what is excluded."""

    min_completeness: float = 0.0
    exclude_domains: tuple[str, ...] = ()
    exclude_email_domains: tuple[str, ...] = ()
    require_email: bool = False
    require_company_domain: bool = False
    require_linkedin: bool = False
    required_fields: tuple[str, ...] = ()
    exclude_free_email: bool = False
    exclude_role_based_email: bool = False
    role_based_email_prefixes: tuple[str, ...] = ROLE_PREFIXES
    exclude_countries: tuple[str, ...] = ()
    include_countries: tuple[str, ...] = ()
    exclude_industries: tuple[str, ...] = ()
    include_industries: tuple[str, ...] = ()
    min_employees: int | None = None
    max_employees: int | None = None
    exclude_seniority: tuple[str, ...] = ()
    include_seniority: tuple[str, ...] = ()
    exclude_titles: tuple[str, ...] = ()
    include_titles: tuple[str, ...] = ()
    exclude_title_keywords: tuple[str, ...] = ()
    include_title_keywords: tuple[str, ...] = ()

    def __post_init__(self):
        if self.min_employees is not None and self.max_employees is not None and self.min_employees > self.max_employees:
            raise ValueError("min_employees must not exceed max_employees")

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) != f.default for f in fields(self) if f.name != "role_based_email_prefixes")


def _folded(values) -> list[str]:
    return list(dict.fromkeys(v.strip().casefold() for v in values if v.strip()))


def first_failure(df: DataFrame, rules: Rules) -> Column:
    """struct<rule, detail> of the first rule that fails, null where all hold."""
    p, c = F.col("person"), F.col("company")
    email, domain, country, industry, size, level, title = p["email"], c["domain"], c["country"], c["industry"], c["employee_count"], p["seniority"], p["job_title"]
    checks: list[tuple[str, Column, Column]] = []
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])

    def drop(rule: str, when: Column, *detail) -> None:
        checks.append((rule, F.coalesce(when, F.lit(False)), text(*detail)))

    if rules.min_completeness > 0:
        drop("min_completeness", F.col("completeness") < rules.min_completeness, "completeness ", F.format_number("completeness", 2), f" below minimum {rules.min_completeness:.2f}")
    if x := _folded(rules.exclude_domains):
        drop("exclude_domains", within(domain, x), "company domain '", domain, "' is excluded")
    if x := _folded(rules.exclude_email_domains):
        drop("exclude_email_domains", email_domain(email).isin(*x), "email domain '", email_domain(email), "' is excluded")
    for on, rule, value, what in ((rules.require_email, "require_email", email, "no email address"), (rules.require_company_domain, "require_company_domain", domain, "no company domain"), (rules.require_linkedin, "require_linkedin", p["linkedin_url"], "no LinkedIn URL")):
        if on:
            drop(rule, value.isNull(), what)
    for path in rules.required_fields:
        drop(f"require_{path.replace('.', '_')}", is_empty(df, path), f"{path} is missing")
    if rules.exclude_free_email:
        drop("exclude_free_email", is_free_mail(email), "'", email, "' is on a consumer mailbox provider")
    if rules.exclude_role_based_email:
        base = F.substring_index(F.substring_index(F.substring_index(F.lower(F.substring_index(email, "@", 1)), "+", 1), ".", 1), "-", 1)
        drop("exclude_role_based_email", one_of(base, _folded(rules.role_based_email_prefixes)), "'", email, "' is a shared/role inbox")
    if rules.exclude_countries:
        drop("exclude_countries", any_of([country_is(country, t) for t in rules.exclude_countries]), "country '", country, "' is excluded")
    if rules.include_countries:
        drop("include_countries", country.isNull(), f"country unknown; only {', '.join(rules.include_countries)} accepted")
        drop("include_countries", ~any_of([country_is(country, t) for t in rules.include_countries]), "country '", country, "' is not in the accepted list")
    if x := _folded(rules.exclude_industries):
        drop("exclude_industries", any_of([F.lower(industry).contains(t) for t in x]), "industry '", industry, "' is excluded")
    if x := _folded(rules.include_industries):
        drop("include_industries", industry.isNull(), "industry unknown")
        drop("include_industries", ~any_of([F.lower(industry).contains(t) for t in x]), "industry '", industry, "' is not in the accepted list")
    if rules.min_employees is not None or rules.max_employees is not None:
        drop("employee_count", size.isNull(), "company size unknown")
    if rules.min_employees is not None:
        drop("min_employees", size < rules.min_employees, size.cast("string"), f" employees is below the minimum {rules.min_employees}")
    if rules.max_employees is not None:
        drop("max_employees", size > rules.max_employees, size.cast("string"), f" employees exceeds the maximum {rules.max_employees}")
    if rules.exclude_seniority:
        drop("exclude_seniority", level.isin(*rules.exclude_seniority), "seniority '", level, "' is excluded")
    if rules.include_seniority:
        drop("include_seniority", ~level.isin(*rules.include_seniority), "seniority '", level, "' is not in the accepted list")
    clean = lambda values: list(dict.fromkeys(" ".join(v.split()).casefold() for v in values if v.strip()))
    if x := clean(rules.exclude_titles):
        drop("exclude_titles", titled(title).isin(*x), "job title '", title, "' is excluded")
    if x := clean(rules.include_titles):
        drop("include_titles", title.isNull(), "job title unknown")
        drop("include_titles", ~titled(title).isin(*x), "job title '", title, "' is not in the accepted list")
    for t in _folded(rules.exclude_title_keywords):
        drop("exclude_title_keywords", F.lower(title).contains(t), "job title '", title, f"' contains '{t}'")
    if x := _folded(rules.include_title_keywords):
        drop("include_title_keywords", title.isNull(), "job title unknown")
        drop("include_title_keywords", ~any_of([F.lower(title).contains(t) for t in x]), "job title '", title, "' matches no accepted keyword")
    none = F.lit(None).cast("struct<rule:string,detail:string>")
    return F.coalesce(*[F.when(when, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, when, detail in checks], none)


def qualify(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``failed`` (rule and detail of the first failure, null where the record is kept)."""
    return df.withColumn("failed", first_failure(df, rules))
