"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The survivors: the first step of the operator. Which record survives is a given order of its fields, that the truth model, which settles the
    values of the survivor (``p1_survivors``), has no part in."""
    from leadloom.llm import survivors

    return survivors.survivors(_read(spark, d, "std_leads")).select("dup_group", "record_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import survivors

    return survivors.fuse(_read(spark, d, "std_leads"))[0]


def p1_source_quality(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import survivors

    return survivors.fuse(_read(spark, d, "std_leads"))[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import cascade

    return cascade.match(_read(spark, d, "raw_leads"), _read(spark, d, "directory_leads")).select("raw_seq", "directory_seq")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import cascade

    return cascade.match(_read(spark, d, "raw_leads"), _read(spark, d, "directory_leads"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import canon

    return canon.match(_read(spark, d, "raw_leads"), _read(spark, d, "canon_values")).select("seq", "field", "canon_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that nothing in the list is meant by, with their rows counted."""
    from pyspark.sql import functions as F

    from leadloom.llm import canon

    found = canon.match(_read(spark, d, "raw_leads"), _read(spark, d, "canon_values"))
    return found.where(F.col("canon_id") == 0).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import components

    return components.lead_groups(_read(spark, d, "raw_leads"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import mojibake

    return mojibake.garbled(_read(spark, d, "raw_leads")).select("seq", "field")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import mojibake

    return mojibake.garbled(_read(spark, d, "raw_leads"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import variants

    return variants.link(_read(spark, d, "raw_leads"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import tokens

    return tokens.encode(_read(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import mixing

    return mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import mixing

    return mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import pii

    return pii.listed(_read(spark, d, "documents"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.llm import pii

    return pii.masked(_read(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_survivors, p1_source_quality, p3_found, p3_matches, p4_found, p4_unmatched, p5_found, p6_found, p6_restored, p7_found, p8_ids, p9_mix, p9_shares, p10_found, p10_masked)}

SQL: dict[str, str] = {
    "p1_found": """
        WITH r AS (
          SELECT dup_group, record_id,
                 coalesce(CASE WHEN isnan(completeness) THEN NULL ELSE CAST(round(completeness * 100) AS BIGINT) END, -1) AS c,
                 source.collected_at AS ts,
                 len(list_distinct(list_filter(list_transform(coalesce(source.sources, []), lambda x: trim(x)),
                     lambda x: x IS NOT NULL AND lower(x) NOT IN ('', 'n/a', '-', 'none', 'null', 'unknown')))) AS s,
                 count(*) OVER (PARTITION BY dup_group) AS n
          FROM std_leads WHERE dup_group IS NOT NULL)
        SELECT dup_group, record_id FROM r WHERE n > 1
        QUALIFY row_number() OVER (PARTITION BY dup_group ORDER BY c DESC, ts DESC NULLS LAST, s DESC, record_id) = 1""",
}
