"""Structural checks of standardized records; all of them, errors and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.urls import aligned, email_domain
from leadloom.functions.vocab import FREE_MAIL, NON_PERSONS
from leadloom.values import let, one_of

# What is said of a value that could not be used.
MESSAGES = {"invalid_domain": "is not a usable domain", "malformed_url": "is not a usable URL", "invalid_email": "is not a usable email address"}


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def found_issues() -> Column:
    """array<struct<rule, severity, message>>."""
    p, c = F.col("person"), F.col("company")
    name = F.trim(p["full_name"])
    person = F.coalesce(p["email"], p["linkedin_url"], p["full_name"]).isNotNull()
    firm = F.coalesce(c["name"], c["domain"]).isNotNull()
    issue = lambda rule, message: F.struct(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), message.alias("message"))
    odd_name = (
        F.when((F.char_length(name) < 2) | name.rlike("^\\p{Nd}+$"), issue("implausible_person_name", F.concat(F.lit("person name "), quoted(name), F.lit(" is not a usable name"))))
        .when(one_of(F.lower(name), NON_PERSONS), issue("non_person_name", F.concat(F.lit("person name "), quoted(name), F.lit(" is a department or placeholder"))))
        .when(F.lower(name) == F.lower(c["name"]), issue("name_equals_company", F.lit("person name duplicates the company name")))
    )
    mismatch = let(
        email_domain(p["email"]),
        lambda host: F.when(
            host.isNotNull() & c["domain"].isNotNull() & ~one_of(host, FREE_MAIL) & ~aligned(host, c["domain"]),
            issue("email_company_mismatch", F.concat(F.lit("email domain "), quoted(host), F.lit(" does not match company domain "), quoted(c["domain"]))),
        ),
    )
    errors = [
        F.when(~(person | firm), issue("no_identity", F.lit("record has no person or company identity"))),
        F.when(F.coalesce(c["name"], c["domain"], p["email"]).isNull(), issue("no_company_signal", F.lit("record has no company name, domain or email to attribute a company"))),
        F.when(p["full_name"].isNotNull() & (name != ""), odd_name),
        F.when(p["email"].isNotNull() & ~p["email"].rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), issue("invalid_email", F.concat(F.lit("email "), quoted(p["email"]), F.lit(" is not a valid address")))),
        mismatch,
    ]
    said = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    warnings = F.transform(
        "normalization_issues",
        lambda i: F.struct(i["rule"].alias("rule"), F.lit("warning").alias("severity"), F.concat_ws(" ", i["field"], quoted(i["value"]), F.coalesce(said[i["rule"]], F.lit("could not be normalized"))).alias("message")),
    )
    return F.concat(F.array_compact(F.array(*errors)), warnings)


def validate(std: DataFrame) -> DataFrame:
    """Adds ``issues``, ``valid``, ``rules`` (distinct, first seen first) and ``issue_text``."""
    df = std.withColumn("issues", found_issues())
    return df.withColumns({
        "valid": ~F.exists("issues", lambda i: i["severity"] == "error"),
        "rules": F.array_distinct(F.transform("issues", lambda i: i["rule"])),
        "issue_text": F.array_join(F.transform("issues", lambda i: i["message"]), "; "),
    })
