"""The best representative of each duplicate group.

Which record survives is decided by completeness, recency, number of sources and id, in this order. Its fields are then
settled by a latent truth model with two-sided source quality: each source has a sensitivity (how often it states a true value
when it states any) and a specificity (how rarely it states a false one) per kind of field, found by expectation-maximisation. A multi-valued field
keeps every value judged true, a single-valued one the likeliest.

A source is judged by a value only where it states something for that field of the group. Before any source is heard, one of the values of a
single-valued field is true, so each of n is with odds of 1 to n - 1; for multi-valued fields the share of true values is learned with the qualities.

A value's probability depends only on its field, the set of sources stating it, the set of sources stating anything for
that field of the group and the number of values there. So the values are counted by this pattern first, and the iterations run over the
pattern counts: the same result as over all values, from a table whose size depends on the sources, not on the rows.

Defined results: groups need two records or more, a null group is none; a record stating a field through several sources counts for each; a value is
compared trimmed and, in fields marked so, without case; placeholders are missing; probability ties go to the survivor's own
value, then to the more often stated, then to the smallest; the extra columns of the input are ignored; a link of
``social_links`` is a claim of its platform and address, joined by U+0001.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, scoped, small
from leadloom.values import present

#: field -> (multi-valued, compared without case)
FIELDS = {
    "person.first_name": (False, False), "person.last_name": (False, False), "person.full_name": (False, False),
    "person.job_title": (False, False), "person.seniority": (False, True), "person.email": (True, True),
    "person.phone": (True, False), "person.linkedin_url": (True, True), "company.name": (False, False),
    "company.domain": (True, True), "company.website": (True, True), "company.industry": (False, True),
    "company.employee_count": (False, False), "company.country": (False, True), "company.city": (False, True),
    "company.linkedin_url": (True, True), "company.description": (False, False), "company.contact_url": (True, True),
}
#: Taken where the records have them: the title as it was sent, and each link of a map as a claim ``platform`` + SEP + ``url``.
RAW_TITLE, LINKS = "person.job_title_raw", "company.social_links"
SEP = "\u0001"
MULTI = (*(f for f, (m, _) in FIELDS.items() if m), LINKS)
FOLDED = (*(f for f, (_, x) in FIELDS.items() if x), LINKS)

ITERATIONS = 8
#: Beta priors (successes, failures) of sensitivity and specificity: sources are rather trusted not to state what is false, by the weight of a few values.
SENSITIVITY = (2.0, 2.0)
SPECIFICITY = (9.0, 1.0)
#: Beta prior of the share of true values of a multi-valued field, and the odds of a single-valued field's only value.
TRUE_SHARE = (6.0, 4.0)
ONLY_VALUE = 9.0


def survivors(records: DataFrame) -> DataFrame:
    """(dup_group, record_id) of the record that survives in each group of two or more."""
    hundredths = F.when(~F.isnan(F.col("completeness")), F.round(F.col("completeness") * 100)).cast("bigint")
    named = F.filter(F.transform(F.coalesce("source.sources", F.array().cast("array<string>")), lambda x: present(x)), lambda x: x.isNotNull())
    order = F.struct(
        F.coalesce(hundredths, F.lit(-(1 << 62))).alias("complete"),
        F.coalesce(F.unix_micros(F.col("source.collected_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"),
        F.size(F.array_distinct(named)).alias("n"),
        (-F.col("record_id")).alias("least"),
    )
    best = records.where(F.col("dup_group").isNotNull()).groupBy("dup_group").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n_records"))
    return best.where(F.col("n_records") > 1).select("dup_group", (-F.col("best.least")).alias("record_id"), "n_records")


def claims(records: DataFrame, kept: DataFrame) -> DataFrame:
    """(dup_group, field, value, source, own, shown): what each source states, in the groups that have a survivor."""
    stated = F.array_distinct(F.filter(F.transform(F.concat(F.array("source.provider"), F.coalesce("source.sources", F.array().cast("array<string>"))), lambda x: F.lower(present(x))), lambda x: x.isNotNull()))
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in FIELDS]
    if "job_title_raw" in records.schema["person"].dataType.names:
        cells.append(F.struct(F.lit(RAW_TITLE).alias("field"), F.col(RAW_TITLE).cast("string").alias("raw")))
    cells = F.array(*cells)
    if "social_links" in records.schema["company"].dataType.names:
        link = lambda e: F.struct(F.lit(LINKS).alias("field"), F.concat_ws(SEP, F.lower(present(e["key"])), present(e["value"])).alias("raw"))
        stated_links = F.filter(F.map_entries(LINKS), lambda e: present(e["key"]).isNotNull() & present(e["value"]).isNotNull())
        cells = F.concat(cells, F.coalesce(F.transform(stated_links, link), F.array().cast("array<struct<field:string,raw:string>>")))
    rows = records.select("record_id", "dup_group", "person", "company", "source").join(kept.select("dup_group", F.col("record_id").alias("survivor")), "dup_group")
    rows = rows.select("dup_group", (F.col("record_id") == F.col("survivor")).alias("own"), F.when(F.size(stated) > 0, stated).otherwise(F.array(F.lit("?"))).alias("stated"), F.explode_outer(cells).alias("c"))
    rows = rows.select("dup_group", "own", "stated", "c.field", present("c.raw").alias("shown")).where(F.col("shown").isNotNull())
    folded = F.col("field").isin(*FOLDED)
    return rows.withColumn("value", F.when(folded, F.lower("shown")).otherwise(F.col("shown")))


def facts(stated: DataFrame) -> DataFrame:
    """One row per value of a field in a group, with its pattern."""
    said = cut(stated.groupBy("dup_group", "field", "value").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("stated")))).alias("by"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n_records"), F.min("shown").alias("shown")
    ))
    over = said.groupBy("dup_group", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("by")))).alias("cover"), F.count(F.lit(1)).alias("n_values"))
    return said.join(over, ["dup_group", "field"]).withColumn("pattern", F.md5(F.concat_ws("\u0002", "field", F.concat_ws(SEP, "by"), F.concat_ws(SEP, "cover"), "n_values")))


def _log(c: Column) -> Column:
    return F.log(F.greatest(c, F.lit(1e-12)))


def quality(patterns: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """EM over the pattern counts (pattern, field, by, cover, n_values, n): the pattern probabilities (pattern, p) and the
    source qualities (field, source, sensitivity, specificity)."""
    multi = F.col("field").isin(*MULTI)
    patterns = patterns.withColumn("multi", multi)
    pairs = cut(patterns.select("pattern", "field", "multi", "n_values", "n", F.explode("cover").alias("source"), "by").select("pattern", "field", "multi", "n_values", "n", "source", F.array_contains("by", F.col("source")).cast("int").alias("said")))
    # At first, values are believed by the share of the covering sources that state them.
    p = cut(patterns.select("pattern", "field", "n", (0.05 + 0.9 * F.size("by") / F.size("cover")).alias("p")))
    n, said, pr = F.col("n"), F.col("said"), F.col("p")
    (a, b), (c, d), (e, g) = SENSITIVITY, SPECIFICITY, TRUE_SHARE
    q = None
    for _ in range(max(1, iterations)):
        q = pairs.join(small(p.select("pattern", "p")), "pattern").groupBy("field", "source").agg(
            ((F.sum(n * pr * said) + a) / (F.sum(n * pr) + a + b)).alias("sensitivity"),
            ((F.sum(n * (1 - pr) * (1 - said)) + c) / (F.sum(n * (1 - pr)) + c + d)).alias("specificity"),
        )
        q = cut(q)  # each round is one job over the pattern pairs
        share = p.groupBy("field").agg(((F.sum(n * pr) + e) / (F.sum(n) + e + g)).alias("share"))
        odds = F.when(said == 1, _log(F.col("sensitivity")) - _log(1 - F.col("specificity"))).otherwise(_log(1 - F.col("sensitivity")) - _log(F.col("specificity")))
        before = F.when(F.col("multi"), _log(F.col("share")) - _log(1 - F.col("share"))).when(F.col("n_values") > 1, -F.log(F.col("n_values") - 1.0)).otherwise(F.log(F.lit(ONLY_VALUE)))
        p = pairs.join(small(q), ["field", "source"]).join(F.broadcast(share), "field")  # a row per field
        p = p.groupBy("pattern", "field", "n").agg((F.sum(odds) + F.first(before)).alias("odds"))
        p = cut(p.select("pattern", "field", "n", (1 / (1 + F.exp(-F.greatest(F.least(F.col("odds"), F.lit(50.0)), F.lit(-50.0))))).alias("p")))
    return p.select("pattern", "p"), q


@scoped
def fuse(records: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """The survivors (dup_group, record_id, n_records, ``fields``: field -> best value, ``kept``: multi-valued field -> values judged
    true) and the source qualities."""
    kept = cut(survivors(records))
    found = cut(facts(claims(records, kept)))
    patterns = cut(found.groupBy("pattern", "field", "by", "cover", "n_values").agg(F.count(F.lit(1)).cast("double").alias("n")))
    p, q = quality(patterns, iterations)
    judged = found.join(small(cut(p)), "pattern")
    multi = F.col("field").isin(*MULTI)
    # The likeliest value, then the survivor's own, then the most often stated, then the smallest: the least of these.
    rank = F.struct((-F.round("p", 9)).alias("p"), (~F.col("own")).alias("own"), (-F.col("n_records")).alias("n"), "shown")
    per_field = judged.groupBy("dup_group", "field").agg(F.min(rank)["shown"].alias("best"), F.array_sort(F.collect_set(F.when(multi & (F.col("p") >= 0.5), F.col("shown")))).alias("true"))
    wide = per_field.groupBy("dup_group").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "best")))).alias("fields"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(multi, F.struct("field", F.when(F.size("true") > 0, F.col("true")).otherwise(F.array("best")).alias("true")))))).alias("kept"),
    )
    return kept.join(wide, "dup_group", "left"), q
