"""Fixed values of the record model: vocabularies, lookup lists, weights and limits.

Every list here must hold exactly these entries for results to be right; they are data, not logic.
"""

# Cells that mean "no value", without case.
NULL_TOKENS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "undefined")

# Seniority levels, and other spellings of them.
SENIORITIES = ("founder", "c_suite", "vp", "director", "manager", "senior", "entry", "intern", "unknown")
SENIORITY_ALIASES = {
    "executive": "c_suite", "cxo": "c_suite", "chief": "c_suite", "ceo": "c_suite", "cto": "c_suite", "cfo": "c_suite", "coo": "c_suite", "cmo": "c_suite",
    "cro": "c_suite", "cio": "c_suite", "cpo": "c_suite", "owner": "founder", "cofounder": "founder", "partner": "founder", "vice_president": "vp", "svp": "vp",
    "evp": "vp", "head": "director", "lead": "manager", "principal": "senior", "staff": "senior", "junior": "entry", "associate": "entry", "trainee": "intern",
}

# Words of a job title by level, most senior first; whole words only where marked with bars.
TITLE_WORDS = {
    "founder": ("founder", "co-founder", "cofounder", "proprietor", "owner", "managing partner"),
    "c_suite": ("chief", "|ceo|", "|cto|", "|cfo|", "|coo|", "|cmo|", "|cro|", "|cio|", "|cpo|", "|cdo|", "|ciso|", "|chro|", "|cso|", "president", "managing director", "general manager"),
    "vp": ("vice president", "vice-president", "|svp|", "|evp|", "|avp|", "|vp|"),
    "director": ("director", "head of"),
    "manager": ("manager", "supervisor", "team lead", "tech lead", "leader"),
    "senior": ("senior", "sr.", "sr ", "principal", "staff ", "lead ", "architect", "distinguished"),
    "intern": ("intern", "internship", "trainee", "apprentice", "working student"),
    "entry": ("junior", "jr.", "jr ", "associate", "assistant", "graduate", "entry level"),
}
# Words in front of "president" that make it another title.
NOT_PRESIDENT = ("vice", "deputy", "assistant")

# Mail hosts of consumers.
FREE_MAIL = (
    "aol.com", "gmx.com", "gmx.de", "gmail.com", "googlemail.com", "hotmail.co.uk", "hotmail.com", "icloud.com", "inbox.com", "live.com", "mail.com", "mail.ru",
    "me.com", "msn.com", "outlook.com", "pm.me", "proton.me", "protonmail.com", "qq.com", "web.de", "y7mail.com", "yahoo.co.uk", "yahoo.com", "yandex.com",
    "yeah.net", "zoho.com", "126.com", "163.com",
)

# Query parameters that only track, by name and by prefix.
TRACKING = (
    "_ga", "_gl", "_openstat", "dclid", "epik", "fbclid", "gbraid", "gclid", "igshid", "li_fat_id", "mkt_tok", "msclkid", "rdt_cid", "s_kwcid", "ttclid", "twclid",
    "vero_conv", "vero_id", "wbraid", "wickedid", "yclid",
)
TRACKING_PREFIXES = ("_hs", "hsa_", "mc_", "oly_", "pk_", "utm_")

# Hosts of social platforms and their names.
SOCIAL = (
    ("linkedin.com", "linkedin"), ("twitter.com", "x"), ("x.com", "x"), ("facebook.com", "facebook"), ("instagram.com", "instagram"), ("github.com", "github"),
    ("gitlab.com", "gitlab"), ("youtube.com", "youtube"), ("youtu.be", "youtube"), ("crunchbase.com", "crunchbase"), ("angel.co", "angellist"),
    ("medium.com", "medium"), ("glassdoor.com", "glassdoor"), ("t.me", "telegram"),
)

# Countries by ISO code, and other keys of them.
COUNTRIES = {
    "AE": "United Arab Emirates", "AR": "Argentina", "AT": "Austria", "AU": "Australia", "BE": "Belgium", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland",
    "CL": "Chile", "CN": "China", "CO": "Colombia", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark", "EE": "Estonia", "EG": "Egypt", "ES": "Spain", "FI": "Finland",
    "FR": "France", "GB": "United Kingdom", "GR": "Greece", "HK": "Hong Kong", "HU": "Hungary", "ID": "Indonesia", "IE": "Ireland", "IL": "Israel", "IN": "India",
    "IT": "Italy", "JP": "Japan", "KR": "South Korea", "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "MX": "Mexico", "MY": "Malaysia", "NG": "Nigeria",
    "NL": "Netherlands", "NO": "Norway", "NZ": "New Zealand", "PH": "Philippines", "PK": "Pakistan", "PL": "Poland", "PT": "Portugal", "RO": "Romania",
    "SA": "Saudi Arabia", "SE": "Sweden", "SG": "Singapore", "SK": "Slovakia", "TH": "Thailand", "TR": "Turkey", "TW": "Taiwan", "UA": "Ukraine",
    "US": "United States", "VN": "Vietnam", "ZA": "South Africa",
}
COUNTRY_ALIASES = {
    "america": "US", "aus": "AU", "britain": "GB", "can": "CA", "chn": "CN", "czech republic": "CZ", "deu": "DE", "deutschland": "DE", "espana": "ES", "gbr": "GB",
    "ger": "DE", "great britain": "GB", "holland": "NL", "india": "IN", "jpn": "JP", "kor": "KR", "mex": "MX", "nederland": "NL", "new zealand": "NZ", "nzl": "NZ",
    "prc": "CN", "rfa": "DE", "sgp": "SG", "singapore": "SG", "south korea": "KR", "the netherlands": "NL", "uae": "AE", "uk": "GB",
    "united states of america": "US", "usa": "US", "viet nam": "VN", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "ukraine": "UA",
}

# Names that are departments or placeholders.
NON_PERSONS = (
    "admin", "administrator", "contact", "customer service", "help desk", "info", "information", "office", "owner", "sales", "support", "team", "test", "unknown", "user",
)
# First parts of shared mailboxes.
ROLE_PREFIXES = (
    "abuse", "admin", "billing", "careers", "contact", "enquiries", "enquiry", "feedback", "hello", "help", "hr", "info", "jobs", "legal", "marketing", "media", "noreply",
    "no-reply", "office", "postmaster", "press", "privacy", "recruiting", "recruitment", "sales", "security", "support", "team", "webmaster",
)

# Points of a present field, of 100.
POINTS = {"email": 25, "full_name": 15, "name": 15, "domain": 15, "job_title": 10, "linkedin_url": 10, "country": 5, "phone": 5}

# Keys of each deduplication strategy, strongest first, and those that are exact.
STRATEGIES = {
    "none": (), "email": ("source_id", "email"), "identity": ("source_id", "email", "linkedin", "phone_name"),
    "aggressive": ("source_id", "email", "linkedin", "phone_name", "name_domain", "name_company"),
}
EXACT_KEYS = ("source_id", "email", "linkedin")

# Limits of kept text.
MAX_ISSUE_VALUE = 200
MAX_DESCRIPTION = 600
MAX_REJECTIONS = 1_000

# Headers of delimited files for each target column.
HEADERS = {
    "first_name": ("first_name", "firstname", "given_name", "fname", "first"),
    "last_name": ("last_name", "lastname", "surname", "family_name", "lname", "last"),
    "full_name": ("full_name", "fullname", "name", "contact_name", "person_name"),
    "job_title": ("job_title", "title", "position", "role", "job_position", "jobtitle"),
    "seniority": ("seniority", "seniority_level", "level"),
    "email": ("email", "email_address", "work_email", "e_mail", "mail", "contact_email"),
    "phone": ("phone", "phone_number", "telephone", "mobile", "mobile_number", "direct_phone", "contact_phone"),
    "linkedin_url": ("linkedin_url", "linkedin", "linkedin_profile", "person_linkedin_url"),
    "company_name": ("company_name", "company", "organization", "organisation", "org_name", "employer", "account_name"),
    "company_domain": ("company_domain", "domain", "website_domain", "primary_domain"),
    "company_website": ("company_website", "website", "url", "company_url", "web"),
    "company_industry": ("company_industry", "industry", "sector", "vertical"),
    "company_employee_count": ("company_employee_count", "employee_count", "employees", "company_size", "headcount", "num_employees", "staff_count"),
    "company_country": ("company_country", "country", "country_name", "location_country"),
    "company_city": ("company_city", "city", "town", "location_city"),
    "company_linkedin_url": ("company_linkedin_url", "company_linkedin", "organization_linkedin_url"),
    "external_id": ("external_id", "id", "record_id", "lead_id", "contact_id"),
    "source_url": ("source_url", "source", "origin_url", "profile_url"),
}
