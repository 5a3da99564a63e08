"""Schemas of the raw and the standardized record, and the order of exported columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DDL = """src_rank int, seq long, provider string, external_id string, source_url string, collected_at timestamp, first_name string, last_name string,
 full_name string, job_title string, seniority string, email string, phone string, linkedin_url string, company_name string, company_domain string,
 company_website string, company_industry string, company_employee_count string, company_country string, company_city string, company_linkedin_url string,
 company_description string, company_contact_url string, company_social_links map<string,string>, raw string"""
PERSON = ("first_name", "last_name", "full_name", "job_title", "job_title_raw", "seniority", "email", "phone", "linkedin_url")
COMPANY = ("name", "domain", "website", "industry", "employee_count", "country", "city", "linkedin_url", "description", "contact_url", "social_links")
STD_DDL = """lead_id string,
 person struct<first_name:string,last_name:string,full_name:string,job_title:string,job_title_raw:string,seniority:string,email:string,phone:string,linkedin_url:string>,
 company struct<name:string,domain:string,website:string,industry:string,employee_count:bigint,country:string,city:string,linkedin_url:string,description:string,contact_url:string,social_links:map<string,string>>,
 source struct<provider:string,external_id:string,source_url:string,collected_at:timestamp,sources:array<string>>,
 normalization_issues array<struct<rule:string,field:string,value:string>>, completeness double"""
#: Columns of raw records that hold text.
TEXT = tuple(x.split()[0] for x in RAW_DDL.replace("\n", " ").split(",") if x.strip().endswith(" string") and x.split()[0] != "raw")


def raw_schema() -> T.StructType:
    return T.StructType.fromDDL(RAW_DDL)


def conform(df: DataFrame, provider: str | None = None, src_rank: int = 0) -> DataFrame:
    """``df`` with every column of the raw schema and no other: absent ones null, present ones cast without failing."""
    have = {f.name: f for f in df.schema}
    cols = []
    for f in raw_schema():
        if f.name == "src_rank" and f.name not in have:
            c = F.lit(src_rank)
        elif f.name == "provider" and f.name not in have:
            c = F.lit(provider)
        elif f.name not in have:
            c = F.lit(None)
        else:
            c = F.col(f.name)
        if f.name in have and isinstance(f.dataType, T.StringType) and isinstance(have[f.name].dataType, T.StringType):
            cols.append(c.alias(f.name))
        else:
            cols.append((c.cast(f.dataType) if f.name not in have or isinstance(f.dataType, T.MapType) else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)
