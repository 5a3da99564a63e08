"""Contact records derived from the customer table, by one SQL text that Spark and DuckDB both read; and SQL fragments of the functions."""

from __future__ import annotations

from leadloom.functions.labels import title_pattern
from leadloom.functions.vocab import COUNTRIES, COUNTRY_ALIASES, FREE_MAIL, NULL_TOKENS, SENIORITIES, SENIORITY_ALIASES, TITLE_WORDS

CONTACTS = """
SELECT k AS seq,
  CASE WHEN m5 = 0 THEN 'crm' ELSE 'csv' END AS provider,
  CASE WHEN m7 = 3 THEN NULL ELSE concat('ext-', CAST(k AS STRING)) END AS external_id,
  CASE WHEN m13 = 0 THEN 'N/A' WHEN m13 = 1 THEN 'SUPPORT' WHEN m13 = 2 THEN concat('Company ', CAST(nk AS STRING)) WHEN m13 = 3 THEN '12345'
       WHEN m5 = 1 THEN concat('  ADA  LOVELACE-', CAST(k % 400 AS STRING), ' ') WHEN m5 = 2 THEN concat('Mary O''NEILL ', CAST(k % 300 AS STRING))
       ELSE concat('Grace Hopper ', CAST(k % 400 AS STRING)) END AS full_name,
  CASE WHEN m7 = 0 THEN 'VP of Sales at Acme' WHEN m7 = 1 THEN 'Vice President, Marketing' WHEN m7 = 2 THEN 'Head of Growth' WHEN m7 = 3 THEN 'Senior Software Engineer'
       WHEN m7 = 4 THEN '-' WHEN m7 = 5 THEN 'Product Manager @ Acme' ELSE 'Growth Hacker' END AS job_title,
  CASE WHEN m11 = 3 THEN 'Head' WHEN m11 = 4 THEN 'c-suite' WHEN m11 = 5 THEN 'Vice President' ELSE NULL END AS seniority,
  CASE WHEN m11 = 0 THEN concat('mailto:USER', CAST(k % 300 AS STRING), '@ACME', CAST(nk AS STRING), '.COM') WHEN m11 = 1 THEN 'not-an-email'
       WHEN m11 = 2 THEN concat('user', CAST(k AS STRING), '@gmail.com') WHEN m11 = 3 THEN concat('Info <info@acme', CAST(nk AS STRING), '.com>')
       WHEN m11 = 4 THEN NULL ELSE concat('user', CAST(k % 300 AS STRING), '@acme', CAST(nk AS STRING), '.com') END AS email,
  CASE WHEN m7 = 1 THEN '0039 02 1234 5678' WHEN m7 = 2 THEN '(415) 555-0142' WHEN m7 = 3 THEN 'N/A' WHEN m7 = 4 THEN '+1 (415) 555-0199' WHEN m7 = 5 THEN '12-34' ELSE NULL END AS phone,
  CASE WHEN m11 = 5 THEN concat('https://de.linkedin.com/pub/User', CAST(k % 200 AS STRING), '?trk=1') WHEN m11 = 6 THEN 'linkedin.com/company/acme' WHEN m11 = 7 THEN 'not a link' ELSE NULL END AS linkedin_url,
  CASE WHEN m13 = 12 THEN NULL ELSE concat('Company ', CAST(nk AS STRING)) END AS company_name,
  CASE WHEN m7 = 6 THEN concat('acme', CAST(nk AS STRING), '.com') WHEN m7 = 5 THEN 'mailto:x@careers.other.org' ELSE NULL END AS company_domain,
  CASE WHEN m5 = 2 THEN NULL WHEN m5 = 3 THEN 'not a domain' ELSE concat('https://www.ACME', CAST(nk AS STRING), '.com:8080/path?q=1') END AS company_website,
  seg AS company_industry,
  CASE WHEN m7 = 0 THEN '201-500' WHEN m7 = 1 THEN '1000+' WHEN m7 = 2 THEN '1.2k' WHEN m7 = 3 THEN 'N/A' WHEN m7 = 4 THEN 'approx. 250' WHEN m7 = 5 THEN '3000000' ELSE '1,200' END AS company_employee_count,
  CASE WHEN m5 = 0 THEN 'usa' WHEN m5 = 1 THEN 'Deutschland' WHEN m5 = 2 THEN 'SG' WHEN m5 = 3 THEN 'Atlantis' ELSE NULL END AS company_country,
  CASE WHEN m11 = 8 THEN 'mailto:a@acme.com' WHEN m11 = 9 THEN concat('HTTP://www.Acme', CAST(nk AS STRING), '.com//Team/?utm_source=x&b=2&B=3&a=1#top') WHEN m11 = 10 THEN 'acme.com:8080/contact/' ELSE NULL END AS company_contact_url
FROM (SELECT CAST(c.c_custkey AS BIGINT) AS k, c.c_nationkey AS nk, c.c_mktsegment AS seg, CAST(c.c_custkey % 7 AS INT) AS m7, CAST(c.c_custkey % 5 AS INT) AS m5,
  CAST(c.c_custkey % 11 AS INT) AS m11, CAST(c.c_custkey % 13 AS INT) AS m13 FROM customer c) base"""

Q = "'"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def clean(c: str) -> str:
    t = f"trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"(CASE WHEN lower({t}) NOT IN {words(NULL_TOKENS)} THEN {t} END)"


def case_token(t: str) -> str:
    return f"CASE WHEN upper({t}) = {t} AND lower({t}) <> {t} THEN upper(left({t}, 1)) || lower(substr({t}, 2)) ELSE {t} END"


def titlecase(c: str) -> str:
    inner = f"array_to_string(list_transform(string_split(y, ''''), lambda z: {case_token('z')}), '''')"
    middle = f"array_to_string(list_transform(string_split(x, '-'), lambda y: {inner}), '-')"
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda x: {middle}), ' ')"


def email(c: str) -> str:
    t = f"trim(regexp_replace({c}, '^mailto:', '', 'i'))"
    inner = f"regexp_extract({t}, '<([^<>@\\s]+@[^<>\\s]+)>', 1)"
    bare = f"lower(regexp_replace(trim(CASE WHEN {inner} <> '' THEN {inner} WHEN {t} NOT LIKE '%<%' AND {t} NOT LIKE '%>%' THEN {t} END), '^[.,;:]+|[.,;:]+$', '', 'g'))"
    return f"(CASE WHEN regexp_full_match({bare}, '[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+') THEN {bare} END)"


def phone(c: str) -> str:
    d = f"regexp_replace(regexp_replace({c}, '[^0-9+]', '', 'g'), '^\\++', '')"
    far = f"({c} LIKE '+%' OR {c} LIKE '00%' OR {d} LIKE '00%')"
    d2 = f"(CASE WHEN {d} LIKE '00%' THEN substr({d}, 3) ELSE {d} END)"
    d3 = f"(CASE WHEN {far} THEN regexp_replace({d2}, '^0+', '') ELSE {d2} END)"
    return f"(CASE WHEN length({d3}) >= 7 THEN CASE WHEN {far} THEN '+' || {d3} ELSE {d3} END END)"


def domain(c: str) -> str:
    t = f"(CASE WHEN contains({c}, '@') AND NOT contains({c}, '/') THEN regexp_replace({c}, '^.*@', '') ELSE {c} END)"
    t = f"regexp_replace(regexp_replace({t}, '^[a-z][a-z0-9+.-]*://', '', 'i'), '[/?#].*$', '')"
    t = f"lower(regexp_replace(trim(regexp_replace(regexp_replace({t}, '^.*@', ''), ':.*$', '')), '^\\.+|\\.+$', '', 'g'))"
    t = f"regexp_replace({t}, '^www\\.', '')"
    return f"(CASE WHEN regexp_full_match({t}, '[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+') THEN {t} END)"


def free(e: str) -> str:
    return f"coalesce({domain(f'CASE WHEN contains({e}, {Q}@{Q}) THEN {e} END')} IN {words(FREE_MAIL)}, FALSE)"


def profile(c: str, kind: str) -> str:
    pattern = "(?:https?://)?(?:[a-z]{2,3}\\.)?(?:www\\.)?linkedin\\.com/(in|company|school|pub)/([^/?#\\s]+)"
    found = f"replace(lower(regexp_extract({c}, '{pattern}', 1, 'i')), 'pub', 'in')"
    wanted = {"person": f"{found} = 'in'", "company": f"{found} = 'company'", "any": f"{found} <> ''"}[kind]
    return f"(CASE WHEN {wanted} THEN 'https://www.linkedin.com/' || {found} || '/' || lower(regexp_extract({c}, '{pattern}', 2, 'i')) END)"


def count(c: str) -> str:
    t = f"trim(replace(replace(regexp_replace({c}, '\\b(?:employees|employee|staff|people|headcount|approx|about)\\b\\.?', ' ', 'gi'), '~', ' '), ',', ''))"
    parts = f"list_filter(regexp_split_to_array({t}, '(?i)\\s*(?:-|–|—|to)\\s*'), lambda x: trim(x) <> '')"
    one = f"(CASE WHEN len({parts}) > 1 THEN {parts}[1] ELSE {t} END)"
    s = f"regexp_replace(trim(regexp_replace(trim({one}), '\\++$', '')), '[,_]', '', 'g')"
    shape = "^([0-9]+(?:\\.[0-9]+)?)\\s*([kmb]?)$"
    unit = f"lower(regexp_extract({s}, '{shape}', 2, 'i'))"
    n = f"CAST(floor(CAST(regexp_extract({s}, '{shape}', 1, 'i') AS DOUBLE) * CASE {unit} WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END) AS BIGINT)"
    return f"(CASE WHEN regexp_matches({s}, '{shape}', 'i') THEN CASE WHEN {n} <= 2000000 THEN {n} END END)"


def country(c: str) -> str:
    key = f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'))"
    names = {v.casefold(): k for k, v in COUNTRIES.items()} | COUNTRY_ALIASES
    return f"(CASE WHEN upper({c}) IN {words(COUNTRIES)} THEN upper({c}) ELSE coalesce(CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" END, {c}) END)"


def seniority(level: str, title: str) -> str:
    key = f"translate(lower(trim({level})), '- ', '__')"
    named = f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ({s: s for s in SENIORITIES if s != "unknown"} | SENIORITY_ALIASES).items()) + " END"
    t = f"(' ' || translate(lower({title}), '/|,', '   ') || ' ')"
    whens = []
    for lv, w in TITLE_WORDS.items():
        # The engine has no look-behind: the blocked forms are taken out before the word is looked for.
        rest = f"regexp_replace({t}, '(vice|deputy|assistant) president', ' ', 'g')" if "president" in w else t
        pattern = title_pattern(tuple(x for x in w if x != "president")) + (r"|\bpresident\b" if "president" in w else "")
        whens.append(f"WHEN regexp_matches({rest}, '{pattern}') THEN '{lv}'")
    return f"coalesce({named}, CASE WHEN {title} IS NULL THEN 'unknown' {' '.join(whens)} ELSE 'unknown' END)"


def strip_suffix(c: str) -> str:
    return clean(f"regexp_replace({c}, '\\s+(?:at|@)\\s+.+$', '', 'i')")


TRACKED = "('_ga','_gl','_openstat','dclid','epik','fbclid','gbraid','gclid','igshid','li_fat_id','mkt_tok','msclkid','rdt_cid','s_kwcid','ttclid','twclid','vero_conv','vero_id','wbraid','wickedid','yclid')"


def page(c: str) -> str:
    scheme = f"lower(regexp_extract({c}, '^([a-z][a-z0-9+.-]*)://', 1, 'i'))"
    # No look-ahead either: the character behind the colon is matched with it.
    like = f"lower(regexp_extract({c}, '^([a-z][a-z0-9+.-]*):(?:[^0-9]|$)', 1, 'i'))"
    t = f"regexp_replace(regexp_replace({c}, '^[a-z][a-z0-9+.-]*://', '', 'i'), '#.*$', '')"
    host = domain(clean(f"regexp_replace({t}, '/.*$', '')"))
    rest = f"(CASE WHEN contains({t}, '/') THEN regexp_replace({t}, '^[^/]*/', '') ELSE '' END)"
    path = f"regexp_replace(regexp_replace({rest}, '\\?.*$', ''), '^/+|/+$', '', 'g')"
    query = f"(CASE WHEN contains({rest}, '?') THEN regexp_replace({rest}, '^[^?]*\\?', '') ELSE '' END)"
    name = "lower(regexp_replace(p, '=.*$', ''))"
    parts = f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND {name} NOT IN {TRACKED} AND NOT regexp_matches({name}, '^(_hs|hsa_|mc_|oly_|pk_|utm_)'))"
    names = f"list_transform({parts}, lambda p: {name})"
    kept = f"array_to_string(list_filter({parts}, lambda p, i: list_position({names}, {name}) = i), '&')"
    return f"(CASE WHEN {scheme} IN ('', 'http', 'https') AND {like} IN ('', 'http', 'https') AND {t} <> '' THEN 'https://' || {host} || CASE WHEN {path} <> '' THEN '/' || {path} ELSE '' END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END)"


def standard() -> str:
    """CTEs ending in ``std``: the flat standardized contacts."""
    cols = ("provider", "external_id", "full_name", "job_title", "seniority", "email", "phone", "linkedin_url", "company_name", "company_domain", "company_website", "company_industry", "company_employee_count", "company_country", "company_contact_url")
    return f"""contacts AS MATERIALIZED ({CONTACTS}),
cl AS MATERIALIZED (SELECT seq, {', '.join(f'{clean(c)} AS {c}' for c in cols)} FROM contacts),
a AS MATERIALIZED (SELECT *, {titlecase('full_name')} AS p_full, {strip_suffix('job_title')} AS p_title, {email('email')} AS p_email, {phone('phone')} AS p_phone, {profile('linkedin_url', 'person')} AS p_page,
  {titlecase('company_name')} AS c_name, {domain('company_domain')} AS c_dom, {domain('company_website')} AS c_site, {count('company_employee_count')} AS c_size, {country('company_country')} AS c_country, {page('company_contact_url')} AS c_contact FROM cl),
b AS MATERIALIZED (SELECT *, {seniority('seniority', 'p_title')} AS p_level, coalesce(c_dom, c_site, CASE WHEN p_email IS NOT NULL AND NOT {free('p_email')} THEN {domain('p_email')} END) AS c_domain FROM a),
std AS MATERIALIZED (SELECT *, (CASE WHEN p_email IS NULL THEN 0 ELSE 25 END + CASE WHEN p_full IS NULL THEN 0 ELSE 15 END + CASE WHEN c_name IS NULL THEN 0 ELSE 15 END + CASE WHEN c_domain IS NULL THEN 0 ELSE 15 END
  + CASE WHEN p_title IS NULL THEN 0 ELSE 10 END + CASE WHEN p_page IS NULL THEN 0 ELSE 10 END + CASE WHEN c_country IS NULL THEN 0 ELSE 5 END + CASE WHEN p_phone IS NULL THEN 0 ELSE 5 END) / 100.0::DOUBLE AS completeness,
  regexp_replace(lower(coalesce(p_full, '')), '[^a-z0-9]', '', 'g') AS slug, regexp_replace(lower(coalesce(c_name, '')), '[^a-z0-9]', '', 'g') AS firm FROM b)"""


def keys() -> str:
    """One row per identity key of each contact, in ladder order."""
    return """(SELECT seq, 1 AS rung, 'source_id' AS key_name, provider || ':' || external_id AS key_value FROM std WHERE external_id IS NOT NULL
 UNION ALL SELECT seq, 2, 'email', p_email FROM std WHERE p_email IS NOT NULL
 UNION ALL SELECT seq, 3, 'linkedin', p_page FROM std WHERE p_page IS NOT NULL
 UNION ALL SELECT seq, 4, 'phone_name', p_phone || '|' || slug FROM std WHERE p_phone IS NOT NULL AND slug <> ''
 UNION ALL SELECT seq, 5, 'name_domain', slug || '@' || c_domain FROM std WHERE slug <> '' AND c_domain IS NOT NULL
 UNION ALL SELECT seq, 6, 'name_company', slug || '@' || firm FROM std WHERE slug <> '' AND c_name IS NOT NULL)"""


def checks() -> str:
    """One row per validation finding of each contact."""
    align = "(h = c_domain OR ends_with(h, '.' || c_domain) OR ends_with(c_domain, '.' || h))"
    return f"""(WITH v AS (SELECT *, {domain("CASE WHEN contains(p_email, '@') THEN p_email END")} AS h FROM std)
 SELECT seq, 'no_identity' AS rule, 'error' AS severity FROM v WHERE coalesce(p_email, p_page, p_full, c_name, c_domain) IS NULL
 UNION ALL SELECT seq, 'no_company_signal', 'error' FROM v WHERE coalesce(c_name, c_domain, p_email) IS NULL
 UNION ALL SELECT seq, CASE WHEN length(p_full) < 2 OR regexp_full_match(p_full, '[0-9]+') THEN 'implausible_person_name'
   WHEN lower(p_full) IN ('admin','administrator','contact','customer service','help desk','info','information','office','owner','sales','support','team','test','unknown','user') THEN 'non_person_name'
   ELSE 'name_equals_company' END, 'error' FROM v WHERE p_full IS NOT NULL AND (length(p_full) < 2 OR regexp_full_match(p_full, '[0-9]+') OR lower(p_full) = lower(coalesce(c_name, ''))
   OR lower(p_full) IN ('admin','administrator','contact','customer service','help desk','info','information','office','owner','sales','support','team','test','unknown','user'))
 UNION ALL SELECT seq, 'email_company_mismatch', 'error' FROM v WHERE h IS NOT NULL AND c_domain IS NOT NULL AND h NOT IN {words(FREE_MAIL)} AND NOT {align}
 UNION ALL SELECT seq, 'invalid_email', 'warning' FROM v WHERE email IS NOT NULL AND p_email IS NULL
 UNION ALL SELECT seq, 'malformed_url', 'warning' FROM v WHERE linkedin_url IS NOT NULL AND {profile('linkedin_url', 'any')} IS NULL
 UNION ALL SELECT seq, 'invalid_domain', 'warning' FROM v WHERE company_domain IS NOT NULL AND c_dom IS NULL
 UNION ALL SELECT seq, 'malformed_url', 'warning' FROM v WHERE company_website IS NOT NULL AND c_site IS NULL
 UNION ALL SELECT seq, 'malformed_url', 'warning' FROM v WHERE company_contact_url IS NOT NULL AND c_contact IS NULL)"""


def failed() -> str:
    """First failed rule of the example rules (see ``queries.EXAMPLE``)."""
    return f"""CASE WHEN completeness < 0.3 THEN 'min_completeness' WHEN c_domain = 'acme3.com' OR ends_with(c_domain, '.acme3.com') THEN 'exclude_domains'
  WHEN {domain("CASE WHEN contains(p_email, '@') THEN p_email END")} = 'acme4.com' THEN 'exclude_email_domains' WHEN c_name IS NULL THEN 'require_company_name'
  WHEN {free('p_email')} THEN 'exclude_free_email' WHEN regexp_replace(regexp_replace(regexp_replace(split_part(p_email, '@', 1), '\\+.*$', ''), '\\..*$', ''), '-.*$', '') IN ('info', 'sales') THEN 'exclude_role_based_email'
  WHEN c_country = 'SG' THEN 'exclude_countries' WHEN c_country IS NULL OR c_country NOT IN ('US', 'DE', 'Atlantis') THEN 'include_countries'
  WHEN contains(lower(company_industry), 'auto') THEN 'exclude_industries' WHEN c_size IS NULL THEN 'employee_count' WHEN c_size < 250 THEN 'min_employees'
  WHEN p_level = 'senior' THEN 'exclude_seniority' WHEN lower(p_title) = 'head of growth' THEN 'exclude_titles' WHEN contains(lower(p_title), 'hacker') THEN 'exclude_title_keywords' END"""
