"""Queries of the core operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import labels, numbers, text, urls
from leadloom.operators import dedup, normalize, qualify, rank, rejects, validate
from leadloom.plans import contacts as sql
from leadloom.plans.rejects_sql import REJECTS
from leadloom.schema import conform
from leadloom.sinks import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rules of the example queries.
EXAMPLE = qualify.Rules(
    min_completeness=0.3, exclude_domains=("acme3.com",), exclude_email_domains=("acme4.com",), required_fields=("company.name",), exclude_free_email=True, exclude_role_based_email=True,
    role_based_email_prefixes=("info", "sales"), exclude_countries=("Singapore",), include_countries=("US", "Deutschland", "Atlantis"), exclude_industries=("auto",), min_employees=250,
    exclude_seniority=("senior",), exclude_titles=("Head of Growth",), exclude_title_keywords=("hacker",),
)


def query(sql_text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql_text is not None:
            SQL[f.__name__] = sql_text
        return f

    return add


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@lru_cache(maxsize=8)
def contacts(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.sql(sql.CONTACTS.replace("FROM customer c", "FROM {customer} c"), customer=_read(spark, folder, "customer"))
    return conform(df.withColumn("src_rank", F.lit(0)))


@lru_cache(maxsize=8)
def standard(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize(contacts(spark, folder), unicode=False)


@lru_cache(maxsize=8)
def annotated(spark: SparkSession, folder: str) -> DataFrame:
    return qualify.qualify(validate.validate(standard(spark, folder)), EXAMPLE)


STD = "WITH " + sql.standard() + " "


@query(REJECTS)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failures(_read(spark, d, "leads_sample_lines"))


@query(STD + "SELECT seq, p_email AS email, p_phone AS phone FROM std")
def norm_email_phone(spark: SparkSession, d: str) -> DataFrame:
    return contacts(spark, d).select("seq", text.normalize_email(text.clean_text("email")).alias("email"), text.normalize_phone(text.clean_text("phone")).alias("phone"))


@query(STD + "SELECT seq, p_full AS full_name, p_title AS job_title, c_name AS company_name FROM std")
def norm_name_title(spark: SparkSession, d: str) -> DataFrame:
    clean = text.clean_text
    return contacts(spark, d).select("seq", text.titlecase(clean("full_name")).alias("full_name"), text.strip_title_suffix(clean("job_title")).alias("job_title"), text.titlecase(clean("company_name")).alias("company_name"))


@query(STD + "SELECT seq, c_dom AS domain, c_site AS site, c_contact AS contact_url, CASE WHEN c_dom IS NOT NULL THEN regexp_extract(c_dom, '[^.]+\\.[^.]+$') END AS apex FROM std")
def norm_urls(spark: SparkSession, d: str) -> DataFrame:
    clean = text.clean_text
    dom = urls.normalize_domain(clean("company_domain"))
    return contacts(spark, d).select("seq", dom.alias("domain"), urls.normalize_domain(clean("company_website")).alias("site"), urls.normalize_page(clean("company_contact_url")).alias("contact_url"), urls.apex_domain(dom).alias("apex"))


@query(STD + f"SELECT seq, p_page AS person_page, {sql.profile('linkedin_url', 'company')} AS company_page FROM std")
def norm_profile(spark: SparkSession, d: str) -> DataFrame:
    c = text.clean_text("linkedin_url")
    return contacts(spark, d).select("seq", urls.normalize_profile(c, "person").alias("person_page"), urls.normalize_profile(c, "company").alias("company_page"))


@query(STD + "SELECT seq, c_size AS employees FROM std")
def employee_count(spark: SparkSession, d: str) -> DataFrame:
    return contacts(spark, d).select("seq", numbers.plausible(numbers.parse_employee_count(text.clean_text("company_employee_count"))).alias("employees"))


@query(STD + "SELECT seq, c_country AS country FROM std")
def country_canonical(spark: SparkSession, d: str) -> DataFrame:
    return contacts(spark, d).select("seq", labels.normalize_country(text.clean_text("company_country")).alias("country"))


@query(STD + "SELECT seq, p_level AS seniority FROM std")
def seniority_infer(spark: SparkSession, d: str) -> DataFrame:
    return standard(spark, d).select("seq", "person.seniority")


@query(STD + "SELECT seq, c_domain AS domain, completeness FROM std")
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    return standard(spark, d).select("seq", "company.domain", "completeness")


@query(STD + f"SELECT seq, key_name, key_value FROM {sql.keys()}")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return standard(spark, d).select("seq", F.explode("identity_keys").alias("k")).select("seq", F.col("k.name").alias("key_name"), F.col("k.value").alias("key_value"))


LEAD_IDS = f"""SELECT s.seq, left(sha256(provider || ':' || coalesce(k.basis, concat_ws('|', p_full, c_name, external_id))), 16) AS lead_id FROM std s
 LEFT JOIN (SELECT seq, arg_min(key_value, rung) AS basis FROM {sql.keys()} WHERE rung > 1 GROUP BY seq) k ON k.seq = s.seq"""


@query(STD + LEAD_IDS)
def lead_id(spark: SparkSession, d: str) -> DataFrame:
    return standard(spark, d).select("seq", "lead_id")


@query(STD + f"SELECT seq, rule, severity FROM {sql.checks()}")
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(standard(spark, d)).select("seq", F.explode("issues").alias("i")).select("seq", "i.rule", "i.severity")


@query(STD + f"SELECT rule, count(DISTINCT seq) AS n_records FROM {sql.checks()} GROUP BY rule")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    return rank.rule_counts(annotated(spark, d))


VALID = f"valid AS (SELECT *, {sql.failed()} AS failed FROM std WHERE seq NOT IN (SELECT seq FROM {sql.checks()} WHERE severity = 'error'))"


@query(STD + f", {VALID} SELECT seq, failed AS rule FROM valid WHERE failed IS NOT NULL")
def filter_first_rule(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).where(F.col("valid") & F.col("failed").isNotNull()).select("seq", "failed.rule")


@query(STD + f", {VALID} SELECT failed AS rule, count(*) AS n_records FROM valid WHERE failed IS NOT NULL GROUP BY failed")
def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return rank.filter_counts(annotated(spark, d))


@query(STD + f""", {VALID} SELECT (SELECT count(*) FROM std) AS n_raw, (SELECT count(*) FROM valid) AS n_valid, (SELECT count(*) FROM std) - (SELECT count(*) FROM valid) AS n_invalid,
 (SELECT count(DISTINCT seq) FROM {sql.checks()} WHERE severity = 'warning') AS n_warned, (SELECT count(*) FROM valid WHERE failed IS NOT NULL) AS n_filtered, (SELECT count(*) FROM valid WHERE failed IS NULL) AS n_kept""")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return rank.stage_counts(annotated(spark, d))


@query(STD + "SELECT provider, count(*) AS n_records FROM std GROUP BY provider")
def provider_counts(spark: SparkSession, d: str) -> DataFrame:
    return rank.provider_counts(annotated(spark, d))


@query(STD + f", {VALID}, ids AS ({LEAD_IDS}) SELECT v.seq, i.lead_id, v.completeness FROM valid v JOIN ids i ON i.seq = v.seq WHERE v.failed IS NULL ORDER BY completeness DESC, lead_id, v.seq LIMIT 100")
def top_leads(spark: SparkSession, d: str) -> DataFrame:
    kept = annotated(spark, d).where(F.col("valid") & F.col("failed").isNull())
    return rank.best_first(kept, 100).select("seq", "lead_id", "completeness")


@query(STD + f""", {VALID} SELECT seq, reason FROM (SELECT seq, 'validation_failed' AS reason FROM std WHERE seq NOT IN (SELECT seq FROM valid)
 UNION ALL SELECT seq, 'filtered_out' FROM valid WHERE failed IS NOT NULL) ORDER BY seq LIMIT 1000""")
def rejection_log(spark: SparkSession, d: str) -> DataFrame:
    return rank.rejections(annotated(spark, d)).select("seq", "reason")


@query(STD + """, keyed AS (SELECT *, row_number() OVER (PARTITION BY p_email ORDER BY seq) AS nth, count(*) OVER (PARTITION BY p_email) AS n FROM std WHERE p_email IS NOT NULL),
 filled AS (SELECT p_email, arg_min(p_full, seq) FILTER (WHERE p_full IS NOT NULL) AS full_name, arg_min(p_phone, seq) FILTER (WHERE p_phone IS NOT NULL) AS phone, min(seq) AS seq, count(*) AS group_size FROM keyed GROUP BY p_email)
 SELECT seq, p_email AS email, full_name, phone, group_size FROM filled UNION ALL SELECT seq, NULL, p_full, p_phone, 1 FROM std WHERE p_email IS NULL""")
def dedup_single_key(spark: SparkSession, d: str) -> DataFrame:
    flat = standard(spark, d).select("src_rank", "seq", "person.email", "person.full_name", "person.phone")
    return dedup.by_key(flat, "email", ["full_name", "phone"], [F.col("src_rank"), F.col("seq")]).drop("src_rank")


@query()
def dedup_greedy_identity(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(standard(spark, d), "identity")[0]


@query()
def dedup_greedy_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(standard(spark, d), "aggressive")[0]


@query()
def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(standard(spark, d), "identity")[1]


@query("""SELECT 0 AS src_rank, seq, name FROM (SELECT c_custkey AS seq, c_name AS name FROM customer ORDER BY c_custkey LIMIT 50)
 UNION ALL SELECT 1, seq, name FROM (SELECT s_suppkey AS seq, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 50)""")
def union_sources_limit(spark: SparkSession, d: str) -> DataFrame:
    a = _read(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    b = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    return rank.union_sources([a, b], 50)


@query(STD + f", ids AS ({LEAD_IDS}) " + """SELECT i.lead_id, p_full AS person_full_name, p_email AS person_email, p_level AS person_seniority, c_domain AS company_domain, c_size AS company_employee_count, provider AS source_provider,
 provider AS sources, completeness FROM std s JOIN ids i ON i.seq = s.seq""")
def flatten_export(spark: SparkSession, d: str) -> DataFrame:
    flat = files.flatten(standard(spark, d))
    return flat.select("lead_id", "person_full_name", "person_email", "person_seniority", "company_domain", "company_employee_count", "source_provider", "sources", "completeness")


@query("SELECT event_id, strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS iso FROM events")
def iso_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", files.iso(F.col("ts").cast("timestamp")).alias("iso"))


@query()
def normalize_raw_leads(spark: SparkSession, d: str) -> DataFrame:
    """The whole of raw_leads in standard form, with Unicode folding."""
    return normalize.normalize(conform(_read(spark, d, "raw_leads")))


@query()
def clean_raw_leads(spark: SparkSession, d: str) -> DataFrame:
    """raw_leads normalized, checked, qualified and ranked."""
    std = qualify.qualify(validate.validate(normalize.normalize(conform(_read(spark, d, "raw_leads")))), qualify.Rules(min_completeness=0.3))
    return rank.best_first(std.where(F.col("valid") & F.col("failed").isNull()))


@query()
def dedup_raw_leads(spark: SparkSession, d: str) -> DataFrame:
    """The whole of raw_leads in standard form, with names of every script, without its duplicates."""
    return dedup.deduplicate(normalize.normalize(conform(_read(spark, d, "raw_leads"))), "identity", unicode=True)[0]
