"""Queries of sources, records, rules and deduplication over inputs made from the customer table, each with its SQL over the same table.

The inputs are files and pages of the shapes that the sources read: the SQL says what should come out of them, straight from the customers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.cluster import shared_folder
from leadloom.functions import urls
from leadloom.operators import dedup, qualify, rank, validate
from leadloom.plans import contacts as sql
from leadloom.plans.queries import LEAD_IDS, STD, _read, query, standard
from leadloom.plans.rejects_sql import REJECTS
from leadloom.sinks import files
from leadloom.sources import company_pages, delimited, people_pages

#: Rules with the halves that the example rules leave out.
LISTS = qualify.Rules(
    require_email=True, require_company_domain=True, required_fields=("person.job_title", "company.country"), include_industries=("Machinery", "BUILD", "furn", "household"), max_employees=1_200,
    include_seniority=("vp", "director", "manager", "senior", "c_suite"), include_titles=("VP of Sales", "vice  president, marketing", "Head of Growth", "Product Manager"), include_title_keywords=("vp", "HEAD", "manager"),
)


@query(STD + """SELECT seq, p_full AS full_name, CASE WHEN contains(p_full, ' ') THEN regexp_replace(p_full, ' [^ ]*$', '') ELSE p_full END AS first_name,
 CASE WHEN contains(p_full, ' ') THEN regexp_extract(p_full, '[^ ]*$') END AS last_name, CASE WHEN job_title <> coalesce(p_title, '') THEN job_title END AS job_title_raw,
 'https://' || coalesce(c_site, c_domain) AS website FROM std""")
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """Names taken apart, the title as it was sent, the website that a domain stands in for."""
    return standard(spark, d).select("seq", "person.full_name", "person.first_name", "person.last_name", "person.job_title_raw", "company.website")


@query(STD + f""", ids AS ({LEAD_IDS}) SELECT i.lead_id, CASE WHEN contains(p_full, ' ') THEN regexp_replace(p_full, ' [^ ]*$', '') ELSE p_full END AS person_first_name,
 CASE WHEN contains(p_full, ' ') THEN regexp_extract(p_full, '[^ ]*$') END AS person_last_name, p_full AS person_full_name, p_title AS person_job_title,
 CASE WHEN job_title <> coalesce(p_title, '') THEN job_title END AS person_job_title_raw, p_level AS person_seniority, p_email AS person_email, p_phone AS person_phone, p_page AS person_linkedin_url,
 c_name AS company_name, c_domain AS company_domain, 'https://' || coalesce(c_site, c_domain) AS company_website, company_industry, c_size AS company_employee_count, c_country AS company_country,
 CAST(NULL AS VARCHAR) AS company_city, CAST(NULL AS VARCHAR) AS company_linkedin_url, CAST(NULL AS VARCHAR) AS company_description, c_contact AS company_contact_url, CAST(NULL AS VARCHAR) AS company_social_links,
 provider AS source_provider, external_id AS source_external_id, CAST(NULL AS VARCHAR) AS source_url, provider AS sources, CAST(NULL AS VARCHAR) AS collected_at, completeness FROM std s JOIN ids i ON i.seq = s.seq""")
def flatten_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every export column."""
    return files.flatten(standard(spark, d))


@query(STD + """, listed AS (SELECT seq, CASE WHEN p_email IS NULL THEN 'require_email' WHEN c_domain IS NULL THEN 'require_company_domain' WHEN p_title IS NULL THEN 'require_person_job_title'
 WHEN c_country IS NULL THEN 'require_company_country' WHEN company_industry IS NULL OR NOT regexp_matches(lower(company_industry), 'machinery|build|furn|household') THEN 'include_industries'
 WHEN c_size IS NULL THEN 'employee_count' WHEN c_size > 1200 THEN 'max_employees' WHEN p_level NOT IN ('vp', 'director', 'manager', 'senior', 'c_suite') THEN 'include_seniority'
 WHEN lower(p_title) NOT IN ('vp of sales', 'vice president, marketing', 'head of growth', 'product manager') THEN 'include_titles'
 WHEN NOT regexp_matches(lower(p_title), 'vp|head|manager') THEN 'include_title_keywords' END AS rule FROM std) SELECT seq, coalesce(rule, 'kept') AS rule FROM listed""")
def filter_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that fails of the required fields and of the lists of what is included."""
    return qualify.qualify(standard(spark, d), LISTS).select("seq", F.coalesce("failed.rule", F.lit("kept")).alias("rule"))


_HOST = sql.domain("CASE WHEN contains(p_email, '@') THEN p_email END")
_ISSUES = [
    ("email", "p_email IS NULL", "is not a usable email address"), ("linkedin_url", f"{sql.profile('linkedin_url', 'any')} IS NULL", "is not a usable URL"), ("company_domain", "c_dom IS NULL", "is not a usable domain"),
    ("company_website", "c_site IS NULL", "is not a usable URL"), ("company_contact_url", "c_contact IS NULL", "is not a usable URL"),
]
_NAMES = "('admin','administrator','contact','customer service','help desk','info','information','office','owner','sales','support','team','test','unknown','user')"


@query(STD + f""", v AS (SELECT *, {_HOST} AS h FROM std), said AS (SELECT seq, [
  CASE WHEN coalesce(p_email, p_page, p_full, c_name, c_domain) IS NULL THEN 'record has no person or company identity' END,
  CASE WHEN coalesce(c_name, c_domain, p_email) IS NULL THEN 'record has no company name, domain or email to attribute a company' END,
  CASE WHEN length(p_full) < 2 OR regexp_full_match(p_full, '[0-9]+') THEN 'person name ''' || p_full || ''' is not a usable name' WHEN lower(p_full) IN {_NAMES} THEN 'person name ''' || p_full || ''' is a department or placeholder'
   WHEN lower(p_full) = lower(c_name) THEN 'person name duplicates the company name' END,
  CASE WHEN h IS NOT NULL AND c_domain IS NOT NULL AND h NOT IN {sql.words(sql.FREE_MAIL)} AND NOT (h = c_domain OR ends_with(h, '.' || c_domain) OR ends_with(c_domain, '.' || h))
   THEN 'email domain ''' || h || ''' does not match company domain ''' || c_domain || '''' END] AS errors,
  [{', '.join(f"CASE WHEN {c} IS NOT NULL AND {bad} THEN '{c} ''' || {c} || ''' {said}' END" for c, bad, said in _ISSUES)}] AS warnings FROM v)
 SELECT seq, len(list_filter(errors, lambda x: x IS NOT NULL)) = 0 AS valid, array_to_string(list_filter(list_concat(errors, warnings), lambda x: x IS NOT NULL), '; ') AS summary FROM said""")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record is valid, and all that is said about it."""
    return validate.validate(standard(spark, d)).select("seq", "valid", F.col("issue_text").alias("summary"))


_EMAIL_GROUPS = """, g AS (SELECT *, coalesce(p_email, 'none ' || seq) AS k FROM std), kept AS (SELECT k, min(seq) AS seq FROM g GROUP BY k)"""


@query(STD + _EMAIL_GROUPS + """, filled AS (SELECT k, arg_min(p_full, seq) FILTER (WHERE p_full IS NOT NULL) AS full_name, arg_min(p_phone, seq) FILTER (WHERE p_phone IS NOT NULL) AS phone,
 arg_min(p_page, seq) FILTER (WHERE p_page IS NOT NULL) AS page, arg_min(p_title, seq) FILTER (WHERE p_title IS NOT NULL) AS title, arg_min(c_country, seq) FILTER (WHERE c_country IS NOT NULL) AS country,
 coalesce(arg_min(p_level, seq) FILTER (WHERE p_level <> 'unknown'), 'unknown') AS seniority, arg_min(c_size, seq) FILTER (WHERE c_size IS NOT NULL) AS employees FROM g GROUP BY k),
 provs AS (SELECT k, provider, min(seq) AS met FROM g GROUP BY k, provider), srcs AS (SELECT k, string_agg(provider, '; ' ORDER BY met) AS sources FROM provs GROUP BY k)
 SELECT kept.seq, full_name, phone, page, title, country, seniority, employees, sources FROM kept JOIN filled USING (k) JOIN srcs USING (k)""")
def dedup_email_merge(spark: SparkSession, d: str) -> DataFrame:
    """The greedy scan by mailbox with merging: gaps filled by later records, sources in the order they were met."""
    kept = dedup.deduplicate(standard(spark, d), "email")[0]
    p, c = "person", "company"
    return kept.select(
        "seq", f"{p}.full_name", f"{p}.phone", F.col(f"{p}.linkedin_url").alias("page"), F.col(f"{p}.job_title").alias("title"), f"{c}.country", f"{p}.seniority", F.col(f"{c}.employee_count").alias("employees"), F.array_join("source.sources", "; ").alias("sources")
    )


@query(STD + f", ids AS ({LEAD_IDS})" + _EMAIL_GROUPS + """ SELECT a.lead_id AS kept_lead_id, b.lead_id AS duplicate_lead_id, coalesce(g.p_full, g.p_email) AS label, 'email' AS matched_key, g.p_email AS matched_value,
 'exact' AS kind, g.provider AS duplicate_provider, g.seq FROM g JOIN kept USING (k) JOIN ids a ON a.seq = kept.seq JOIN ids b ON b.seq = g.seq WHERE g.seq <> kept.seq""")
def dedup_email_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(standard(spark, d), "email", merge=False)[1].drop("src_rank")


@query(STD + _EMAIL_GROUPS + """ SELECT (SELECT count(*) FROM std) AS considered, (SELECT count(*) FROM std) - (SELECT count(*) FROM kept) AS exact, CAST(0 AS BIGINT) AS probable,
 (SELECT count(*) FROM std) AS kept_by_none""")
def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    std = standard(spark, d)
    pairs = dedup.deduplicate(std, "email", merge=False)[1]
    none = dedup.deduplicate(std, "none")[0].agg(F.count(F.lit(1)).alias("kept_by_none"))
    counts = pairs.agg(F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "probable").alias("probable"))
    return std.agg(F.count(F.lit(1)).alias("considered")).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(none))  # one row each


_CELLS = ", ".join(f"cells[{i + 1}] AS {c}" for i, c in enumerate(("first_name", "last_name", "position", "email_address", "direct_phone", "linkedin_profile", "company", "website", "industry", "employees", "country", "city")))


@query(REJECTS[: REJECTS.index("SELECT DISTINCT line_id, reason")] + ", bad AS (" + REJECTS[REJECTS.index("SELECT DISTINCT line_id, reason") :] + f") SELECT line_id, {_CELLS} FROM shape WHERE line_id NOT IN (SELECT line_id FROM bad)")
def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.operators import rejects

    return rejects.load(_read(spark, d, "leads_sample_lines"))


_LINE = """CASE WHEN c_custkey % 17 = 0 THEN '"open;x' || c_custkey || '@a.io;A;1;z' WHEN c_custkey % 19 = 0 THEN ' ; ;;;' WHEN c_custkey % 5 = 0 THEN '"' || c_name || '; Jr ' || repeat(chr(34), 2) || 'Q' || repeat(chr(34), 3) || ';' || c_custkey || '@a.io;;12'
 ELSE chr(9) || ' ' || c_name || ' ;' || c_custkey || '@a.io;' || c_mktsegment || ';;' || c_custkey END"""


@query("""SELECT CASE WHEN c_custkey % 5 = 0 THEN c_name || '; Jr "Q"' ELSE c_name END AS full_name, c_custkey || '@a.io' AS email, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS company_name,
 CASE WHEN c_custkey % 5 = 0 THEN '12' END AS company_employee_count, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS external_id, 'file' AS provider FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0""")
def delimited_records(spark: SparkSession, d: str) -> DataFrame:
    """A folder of delimited files, a header in each: sniffed, headers by their spellings and by a map, cells trimmed, blank rows and lines that break the CSV rules left out."""

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["Name;E-Mail;Company;Staff Count;Cust"]})
        yield from batches

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _read(spark, d, "customer").selectExpr(f"{_LINE} AS value").mapInPandas(headed, "value string").write.text(path)
    return delimited.read(spark, path, "file", column_map=["external_id=Cust"]).select("full_name", "email", "company_name", "company_employee_count", "external_id", "provider")


@query("""SELECT (c_nationkey * 1048576 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) AS seq, CAST(c_custkey AS VARCHAR) AS external_id, 'https://people.example/people/' || c_custkey AS source_url,
 c_name AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'CTO' END AS job_title, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN 'n' || c_name END AS phone, c_mktsegment AS company_name,
 CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_nationkey || '.example' ELSE 'd' || c_nationkey || '.example' END AS company_domain, CAST(c_nationkey AS VARCHAR) AS company_employee_count FROM customer""")
def people_records(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages of a people search (one a nation), decoded and mapped."""
    c, k = _read(spark, d, "customer"), F.col("c_custkey")
    numbers = F.when(k % 4 == 1, F.array(F.struct(F.lit(" ").alias("sanitized_number"), F.lit(None).cast("string").alias("raw_number"), F.concat(F.lit("n"), "c_name").alias("number"))))
    firm = F.struct(
        F.col("c_mktsegment").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("p"), F.col("c_nationkey"), F.lit(".example"))).otherwise(" ").alias("primary_domain"), F.concat(F.lit("d"), F.col("c_nationkey"), F.lit(".example")).alias("domain"), F.col("c_nationkey").alias("estimated_num_employees")
    )
    person = F.struct(k.alias("id"), F.concat(F.lit("\t "), F.col("c_name"), F.lit(" ")).alias("name"), F.when(k % 3 == 0, "CTO").otherwise(" ").alias("title"), F.when(k % 4 == 0, F.col("c_name")).alias("sanitized_phone"), numbers.alias("phone_numbers"), firm.alias("organization"))
    # A page holds the people of a nation here, in order; the pages of the service hold a hundred at most.
    pages = c.groupBy(F.col("c_nationkey").cast("long").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), person.alias("p")))).alias("all"))
    value = F.when(F.col("page_no") % 2 == 0, F.to_json(F.struct(F.col("all.p").alias("people")))).otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("people"), F.col("all.p").alias("contacts"))))
    return people_pages.to_raw(people_pages.people(pages.select("page_no", value.alias("value")))).select("seq", "external_id", "source_url", "full_name", "job_title", "phone", "company_name", "company_domain", "company_employee_count")


_TOLD = "s_suppkey % 6 <> 5"


@query(f"""SELECT 's' || s_suppkey || '.example' AS company_domain, 'https://s' || s_suppkey || '.example' AS source_url,
 CASE WHEN s_suppkey % 6 = 0 THEN s_name || ' Org' WHEN s_suppkey % 6 = 1 THEN s_name || ' Site' WHEN s_suppkey % 6 IN (2, 3) THEN s_name END AS company_name,
 CASE WHEN s_suppkey % 6 = 0 THEN 'about ' || s_suppkey WHEN s_suppkey % 6 IN (1, 2) THEN 'meta ' || s_suppkey END AS company_description, CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS company_employee_count,
 CASE WHEN s_suppkey % 6 = 0 THEN 'DE' END AS company_country, CASE WHEN s_suppkey % 6 <= 3 THEN 'info@s' || s_suppkey || '.example' END AS email,
 CASE WHEN s_suppkey % 6 = 4 THEN NULL ELSE 'https://s' || s_suppkey || '.example/kontakt' END AS company_contact_url,
 CASE WHEN s_suppkey % 6 = 4 THEN 'x=https://x.com/s' || s_suppkey WHEN s_suppkey % 6 = 0 THEN 'github=https://github.com/o' || s_suppkey || '; x=https://x.com/s' || s_suppkey ELSE 'x=https://x.com/s' || s_suppkey END AS social
 FROM supplier WHERE {_TOLD}""")
def site_records(spark: SparkSession, d: str) -> DataFrame:
    """Three pages a supplier's site (home, contact, and the home page under another spelling), parsed and folded; every sixth site says nothing."""
    s, k = _read(spark, d, "supplier"), F.col("s_suppkey")
    m, name, n = k % 6, F.col("s_name"), k.cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    org = text('<script type="application/ld+json">{"@graph": [{"@type": "Corporation", "name": "', name, ' Org", "description": "about ', n, '", "numberOfEmployees": {"value": ', n, '}, "address": {"addressCountry": {"name": "DE"}}, "sameAs": ["https://github.com/o', n, '"]}]}</script>')
    home = F.when(m == 5, "<p>nothing</p>").when(m == 4, text('<a href="https://x.com/s', n, '">x</a>')).otherwise(
        text(
            "<title>Home | ", name, "</title>", F.when(m == 0, org).otherwise(""), F.when(m == 1, text('<meta property="og:site_name" content="', name, ' Site">')).otherwise(""),
            F.when(m < 3, text('<meta name="description" content="meta ', n, '">')).otherwise(""), '<a href="/kontakt/?utm_source=x">k</a><a href="https://x.com/s', n, '">x</a>',
        )
    )
    inner = F.when(m < 4, text('<title>Kontakt</title><a href="mailto:INFO@s', n, '.example?subject=a">m</a><a href="https://x.com/later">x</a>')).otherwise("")
    rows = F.explode(F.array(
        F.struct((k * 10).alias("page_id"), text("HTTP://www.s", n, ".example/").alias("url"), home.alias("html")), F.struct((k * 10 + 1).alias("page_id"), text("https://s", n, ".example/kontakt").alias("url"), inner.alias("html")),
        F.struct((k * 10 + 2).alias("page_id"), text("s", n, ".example").alias("url"), F.lit("<title>Other</title>").alias("html")),
    ))
    found = company_pages.to_raw(s.select(rows.alias("p")).select("p.*"))
    return found.select("company_domain", "source_url", "company_name", "company_description", "company_employee_count", "company_country", "email", "company_contact_url", files.render_links(F.col("company_social_links")).alias("social"))


@query("""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'linkedin=https://www.linkedin.com/company/s' || s_suppkey WHEN 1 THEN 'x=https://x.com/s' || s_suppkey WHEN 2 THEN 'youtube=https://youtu.be/s' || s_suppkey
 WHEN 3 THEN 'angellist=https://angel.co/company/s' || s_suppkey WHEN 5 THEN 'facebook=https://m.facebook.com/s' || s_suppkey END AS links FROM supplier""")
def social_pages(spark: SparkSession, d: str) -> DataFrame:
    """The platforms of pages: by suffix of the host, with a path, the first page of each; LinkedIn pages in canonical form."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    page = (
        F.when(k % 8 == 0, text("http://DE.linkedin.com/company/S", n, "/?trk=1")).when(k % 8 == 1, text("https://www.x.com/s", n)).when(k % 8 == 2, text("youtu.be/s", n))
        .when(k % 8 == 3, text("https://angel.co/company/s", n, "#top")).when(k % 8 == 4, "https://facebook.com/").when(k % 8 == 5, text("m.facebook.com/s", n)).when(k % 8 == 6, text("https://notx.com/s", n)).otherwise("N/A")
    )
    second = F.when(k % 8 == 1, "https://twitter.com/later")
    return _read(spark, d, "supplier").select("s_suppkey", files.render_links(urls.social_links(F.array_compact(F.array(page, second)))).alias("links"))


@query(STD + f", found AS {sql.checks()} SELECT rule, n_records, row_number() OVER (ORDER BY n_records DESC, rule) AS place FROM (SELECT rule, count(DISTINCT seq) AS n_records FROM found GROUP BY rule)")
def rule_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The validation rules by how often they fired, as the summary of a run lists them."""
    from pyspark.sql.window import Window

    counts = rank.by_count(rank.rule_counts(validate.validate(standard(spark, d))))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_records"), "rule")))  # no more rows than there are rules
