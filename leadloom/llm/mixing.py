"""Mix of several sources in target shares of all tokens.

Systematic sampling: every document has an expected number of copies (its source's rate); these are summed
up within the source in the order of size (equal sizes in a seeded random order), one random offset per source is added, and the document comes out once
for each whole number that its interval crosses. Copies of documents of one source therefore differ by one at most and never
exceed the cap, and the size taken of a source is as near to its rate as single documents allow.

Going by size, the offset hardly changes how many tokens a source gives, while every document keeps its expected copies.
The prefix sum is taken in two levels (slices of the order, then inside a slice), so one source, or one size, that holds most documents is
spread over all tasks.

Rates: a source with target share t and size z gets r = t * total / z, at most ``max_repeats``. ``total`` is by default the largest for
which every listed source that has documents reaches its share within its cap; listed sources without documents are reported with 0.

Defined results: only sources of the targets take part; null and empty texts have no size and never come out; of a source listed
more than once the first row by (share, cap) counts; a null or negative share or cap counts as 0; equal texts are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.cluster import cut, small
from leadloom.llm.tokens import TOKENIZERS, encoding

#: Slices of the documents of one size class.
SLICES = 256


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(tokenizer, folder)
        for t in texts:
            yield pd.Series([len(e.encode_ordinary(x)) if x else 0 for x in t], dtype="int64")

    return documents.select("doc_id", "source", count("text").alias("n_tokens"))


def clean_targets(targets: DataFrame) -> DataFrame:
    share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
    cap = F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0))
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct(share.alias("share"), cap.alias("cap"))).alias("t"))
    return t.select("source", F.col("t.share").alias("target_share"), F.col("t.cap").alias("max_repeats"))


def rates(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per listed source: target_share, max_repeats, source_tokens, rate (expected copies)."""
    have = sized.where(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    t = clean_targets(targets).join(have, "source", "left").fillna(0, ["source_tokens"])
    most = F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")
    if total is None:
        bound = t.agg(F.min(F.when((F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), most)).alias("total"))
    else:
        bound = sized.sparkSession.createDataFrame([(float(total),)], "total double")
    rate = F.col("target_share") * F.coalesce("total", F.lit(0.0)) / F.col("source_tokens")
    t = t.crossJoin(F.broadcast(bound))  # one row
    return t.select("source", "target_share", "max_repeats", "source_tokens", F.when(F.col("source_tokens") > 0, F.least(rate, F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"))


def size_class(n: Column) -> Column:
    """Sizes up to 1,024 each on their own, beyond it 64 classes an octave: a few thousand at most."""
    return F.when(n <= 1024, n.cast("int")).otherwise((1024 + 64 * (F.log2(n.cast("double")) - 10)).cast("int"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, copy_no, n_tokens) and the shares (one row per listed source)."""
    sized = cut(token_counts(documents, tokenizer, folder))
    plan = small(cut(rates(sized, targets, total)))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    ranked = sized.where(F.col("n_tokens") > 0).join(plan.where(F.col("rate") > 0).select("source", "rate", "max_repeats"), "source")
    ranked = ranked.select("doc_id", "source", "n_tokens", "rate", "max_repeats", key.alias("key"), F.struct(size_class(F.col("n_tokens")).alias("size"), F.pmod(F.shiftrightunsigned(key, 20), F.lit(slices)).cast("int").alias("part")).alias("slice"))
    # Slices are summed by count: the expected copies are equal within a source, and whole numbers add up exactly.
    before = ranked.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source", "slice", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "n_tokens")
    at = ranked.withColumn("k", F.row_number().over(inside)).join(before, ["source", "slice"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.lit("offset")), F.lit(1 << 30)) / float(1 << 30)
    end = F.floor((F.col("before") + F.col("k")) * F.col("rate") + offset)
    begin = F.floor((F.col("before") + F.col("k") - 1) * F.col("rate") + offset)
    copies = F.least(end - begin, F.col("max_repeats").cast("bigint"))
    picked = at.select("doc_id", "source", "n_tokens", copies.alias("copies")).where(F.col("copies") > 0)
    picked = cut(picked)
    rows = picked.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens")
    got = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"))
    shares = plan.join(got, "source", "left").fillna(0, ["mix_tokens", "n_docs", "n_copies", "most_repeats"])
    everything = shares.agg(F.sum("mix_tokens").alias("all_tokens"))
    reached = F.when(F.col("all_tokens") > 0, F.col("mix_tokens") / F.col("all_tokens")).otherwise(0.0)
    shares = shares.crossJoin(F.broadcast(everything)).select("source", "target_share", reached.alias("reached_share"), "max_repeats", "most_repeats", "source_tokens", "mix_tokens", "n_docs", "n_copies")
    return rows, shares
