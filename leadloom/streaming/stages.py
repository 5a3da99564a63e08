"""The row-local stages on a stream, and a windowed count of what they find. Deduplication across the whole history is a batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.normalize import normalize
from leadloom.operators.qualify import Rules, qualify
from leadloom.operators.validate import validate


def annotate(stream: DataFrame, rules: Rules = Rules(), unicode: bool = True) -> DataFrame:
    """Raw records of a stream, normalized, checked and qualified, without state."""
    return qualify(validate(normalize(stream, unicode)), rules)


def counts(annotated: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records, valid ones and kept ones per provider and window of collection; later than ``late`` is dropped by the watermark."""
    at = annotated.withColumn("at", F.col("source.collected_at")).withColumn("provider", F.col("source.provider"))
    return at.withWatermark("at", late).groupBy(F.window("at", window), "provider").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & F.col("failed").isNull()).alias("n_kept"))
