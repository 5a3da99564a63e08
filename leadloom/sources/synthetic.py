"""Made-up contact records, the same for the same seed however they are split: every row depends on its number and the seed only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.schema import conform

FIRST = ("Ada", "Grace", "Alan", "Edsger", "Barbara", "Donald", "Hedy", "Linus")
LAST = ("Lovell", "Hopman", "Turin", "Dijkman", "Liskow", "Knutsen", "Lamar", "Torv")
TITLES = ("Chief Technology Officer", "VP of Sales", "Head of Data", "Software Engineer", "Office Manager")


def generate(spark: SparkSession, n: int, seed: int = 42, duplicate_ratio: float = 0.15, messy_ratio: float = 0.25, src_rank: int = 0) -> DataFrame:
    """``n`` raw records; about ``duplicate_ratio`` repeat an earlier identity, about ``messy_ratio`` are untidy."""
    draw = lambda what, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), k), F.lit(1_000_000))
    pick = lambda values, what, k: F.get(F.array(*[F.lit(v) for v in values]), draw(what, k) % len(values))
    df = spark.range(1, n + 1).withColumnRenamed("id", "seq")
    earlier = F.when((F.col("seq") > 1) & (draw("dup", F.col("seq")) < int(duplicate_ratio * 1e6)), 1 + draw("which", F.col("seq")) % (F.col("seq") - 1)).otherwise(F.col("seq"))
    df = df.withColumn("who", earlier).withColumn("messy", draw("messy", F.col("seq")) < int(messy_ratio * 1e6))
    who = F.col("who")
    first, last, firm = pick(FIRST, "first", who), pick(LAST, "last", who), F.concat(F.lit("acme"), (draw("firm", who) % 50).cast("string"))
    mail = F.concat(F.lower(first), F.lit("."), F.lower(last), who.cast("string"), F.lit("@"), firm, F.lit(".example"))
    rows = df.select(
        "seq", F.lit("synthetic").alias("provider"), F.format_string("mock-%06d", "seq").alias("external_id"), F.when(F.col("messy"), F.upper(first)).otherwise(first).alias("first_name"), last.alias("last_name"),
        F.when(~F.col("messy"), F.concat_ws(" ", first, last)).alias("full_name"), pick(TITLES, "title", who).alias("job_title"), F.when(F.col("messy"), F.concat(F.lit("  MAILTO:"), F.upper(mail))).otherwise(mail).alias("email"),
        F.when(F.col("messy"), F.lit("N/A")).otherwise(F.concat(F.lit("+49 30 "), F.lpad(draw("phone", who).cast("string"), 6, "0"))).alias("phone"), F.initcap(firm).alias("company_name"),
        F.when(F.col("messy"), F.concat(F.lit("HTTPS://www."), F.upper(firm), F.lit(".example/x"))).otherwise(F.concat(firm, F.lit(".example"))).alias("company_domain"), (10 + draw("size", who) % 5000).cast("string").alias("company_employee_count"),
    )
    return conform(rows, "synthetic", src_rank)
