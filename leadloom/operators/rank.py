"""Union, order, limits and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.vocab import MAX_REJECTIONS


def union_sources(frames: list[DataFrame], limit: int | None = None) -> DataFrame:
    """All sources in requested order, each limited on its own before the union."""
    parts = [(f.orderBy("seq").limit(limit) if limit is not None else f).withColumn("src_rank", F.lit(i).cast("int")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def best_first(std: DataFrame, limit: int | None = None) -> DataFrame:
    """By completeness, then id, then first seen; a limit makes it a top-k, not a sort."""
    df = std.orderBy(F.desc("completeness"), "lead_id", "src_rank", "seq")
    return df.limit(limit) if limit is not None else df


def stage_counts(annotated: DataFrame) -> DataFrame:
    """One row: how many records each stage saw, let through and dropped."""
    n = lambda cond: F.count_if(cond).alias
    return annotated.agg(
        F.count(F.lit(1)).alias("n_raw"), n(F.col("valid"))("n_valid"), n(~F.col("valid"))("n_invalid"), n(F.exists("issues", lambda i: i["severity"] == "warning"))("n_warned"),
        n(F.col("valid") & F.col("failed").isNotNull())("n_filtered"), n(F.col("valid") & F.col("failed").isNull())("n_kept"),
    )


def rule_counts(annotated: DataFrame) -> DataFrame:
    """(rule, n_records) of validation rules, once per record, rejected or not."""
    return annotated.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_records"))


def filter_counts(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("valid") & F.col("failed").isNotNull()).groupBy(F.col("failed.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_records"))


def provider_counts(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy(F.col("source.provider").alias("provider")).agg(F.count(F.lit(1)).alias("n_records"))


def rejections(annotated: DataFrame, pairs: DataFrame | None = None, cap: int = MAX_REJECTIONS) -> DataFrame:
    """(phase, src_rank, seq, provider, label, reason, detail): rejected records in input order, then duplicates, ``cap`` of them."""
    name = F.col("label")
    row = lambda reason, detail: (F.lit(0).alias("phase"), "src_rank", "seq", F.col("source.provider").alias("provider"), name.alias("label"), F.lit(reason).alias("reason"), detail.alias("detail"))
    bad = annotated.where(~F.col("valid")).select(*row("validation_failed", F.col("issue_text")))
    out = annotated.where(F.col("valid") & F.col("failed").isNotNull()).select(*row("filtered_out", F.concat_ws(": ", "failed.rule", "failed.detail")))
    every = bad.unionByName(out)
    if pairs is not None:
        every = every.unionByName(pairs.select(F.lit(1).alias("phase"), "src_rank", "seq", F.col("duplicate_provider").alias("provider"), "label", F.lit("duplicate").alias("reason"), F.concat_ws("=", "matched_key", "matched_value").alias("detail")))
    return every.orderBy("phase", "src_rank", "seq").limit(min(cap, MAX_REJECTIONS))


def by_count(counts: DataFrame) -> DataFrame:
    """(rule, n_records), the most frequent first."""
    return counts.orderBy(F.desc("n_records"), "rule")
