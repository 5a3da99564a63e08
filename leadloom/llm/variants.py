"""Rows that name the same person, or the same organisation, under different spellings.

Suffix blocking: the index holds, inside a company, the suffix of every token of a name (given name under each name it may stand for, and surname), and names are
compared where they share one. Suffixes that many names of a company share (``-berg``, ``-mann``) are refined with the other tokens of the name before
they are let go: there, the whole token together with what remains of the other part after deletions is the key. Two spellings of one person share a
given name or a surname as a whole, so whichever way a suffix goes, no pair that qualifies is lost, by the size of a block or by where the letters differ. Names of a common mailbox or profile
are compared as well. Pairs are compared by the ratio of their longest common subsequence. Names of organisations meet by the suffixes
of their words, under the same ratio (``people``).

Names are compared as forms (distinct company, given name, surname), so that a name carried by many rows is compared once. Forms that match make persons;
a form with an initial joins the only person it fits. The pairs of rows come last, and persons or organisations with many rows are split into chunks, whose
pairs are made in separate tasks.

Defined results: rows need a name of two parts and a company to name a person; departments are none; rows without any person field name an organisation; a null
seq is left out, a repeated one is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, scoped
from leadloom.llm.people import RATIO, common, digest, forms, ratio, suffix, taken, with_keys
from leadloom.llm.people import one_edit as near
from leadloom.llm.people import variants as deleted
from leadloom.operators.graph import propagate

__all__ = ["common", "ratio"]
#: Names of a company that a suffix may have before it is refined, and length from which on a surname is not taken apart for it.
REFINE = 64
LONG = 14
#: Ratio that is enough for rows of one mailbox or profile.
RATIO_LINKED = 0.6
#: Of two given names an edit apart, the rarer is a typing error if it is this much rarer.
RARER = 0.1
#: Rows of one person or organisation from which on its pairs are made in chunks.
CHUNK = 1_000


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def same_person(ga: str, sa: str, na: int, alts_a, gb: str, sb: str, nb: int, alts_b, linked: bool) -> bool:
    """Whether two names (given, surname sound, rows of the given name, what it may stand for) are spellings of one."""
    given = bool(set(alts_a) & set(alts_b))
    sur = sa == sb
    if given and sur:
        return True
    near_sur = sur or ratio(sa, sb) >= (RATIO_LINKED if linked else RATIO) and (linked or min(len(sa), len(sb)) >= 4)
    near_given = given or (min(len(ga), len(gb)) >= 4 and one_edit(ga, gb) and min(na, nb) <= RARER * max(na, nb))
    if linked:
        return near_sur and (near_given or ratio(ga, gb) >= RATIO_LINKED)
    return (given and near_sur) or (sur and near_given)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [same_person(*x) for x in zip(*(b[c] for c in ("ga", "sa", "na", "alts_a", "gb", "sb", "nb", "alts_b", "linked")))]
        yield b.loc[ok, ["a", "b"]]


def deletions(skel: str) -> list[str]:
    """The name with up to as many letters left out as a name within ``RATIO`` of it may lack."""
    # Of lengths n and m with c letters in common 2c >= RATIO (n + m), and m >= c: n lacks at most this many.
    most = int(len(skel) * (2 - 2 * RATIO) / (2 - RATIO) + 1e-9)
    found = now = {skel}
    for _ in range(most):
        now = {t[:i] + t[i + 1 :] for t in now for i in range(len(t))}
        found = found | now
    return sorted(found)


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys = [(deletions(x) if len(x) < LONG else []) + (["*"] if len(x) >= LONG * RATIO / (2 - RATIO) else []) for x in b["skel"]]
        yield b.assign(block=[[f"{k}\u0001{x}" for x in xs] for k, xs in zip(b["block"], keys)]).explode("block").dropna(subset=["block"])[["form", "skel", "block"]]


def alike(a: Column, b: Column) -> Column:
    """What every two surnames within ``RATIO`` fulfil: a common subsequence bounds the edits."""
    return F.levenshtein(a, b) <= (1 - RATIO) * (F.char_length(a) + F.char_length(b)) + 1e-9


def by_suffix(full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the forms of one company that share a token's suffix with no more than REFINE others, as far as they may be one person; and the (company, suffix) that more share."""
    tokens = F.array_distinct(F.concat(F.transform("alts", suffix), F.array(suffix(F.col("skel")))))
    index = cut(full.select("form", "company", "given", "skel", "alts", F.explode_outer(tokens).alias("suffix")))
    sizes = cut(index.groupBy("company", "suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    rare = index.join(sizes.where(F.col("n") <= REFINE).select("company", "suffix"), ["company", "suffix"])
    a, b = (rare.select("company", "suffix", F.col("form").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("given", "skel", "alts")]) for s in ("a", "b"))
    given, sur = F.arrays_overlap("alts_a", "alts_b"), F.col("skel_a") == F.col("skel_b")
    may = (given & alike(F.col("skel_a"), F.col("skel_b"))) | (sur & near(F.col("given_a"), F.col("given_b")))
    return a.join(b, ["company", "suffix"]).where((F.col("a") < F.col("b")) & may).select("a", "b"), sizes.where(F.col("n") > REFINE).select("company", "suffix")


def same_given(full: DataFrame) -> DataFrame:
    """(a, b) of the forms of one company that share a given name and have surnames that may be within ``RATIO``: all such pairs.

    They have a common remainder after deletions; surnames of ``LONG`` letters and more, which have too many, meet each other and the ones near that length directly.
    """
    index = full.select("form", "skel", F.concat_ws("\u0001", "company", "alt").alias("block"))
    blocks = index.mapInPandas(_refine, "form binary, skel string, block string")
    a, b = (blocks.select(F.col("form").alias(s), F.col("skel").alias(f"s{s}"), "block") for s in ("a", "b"))
    return a.join(b, "block").where((F.col("a") < F.col("b")) & alike(F.col("sa"), F.col("sb"))).select("a", "b")


def same_surname(full: DataFrame) -> DataFrame:
    """(a, b) of the forms of one company and surname sound whose given names are an edit apart."""
    index = full.where(F.char_length("given") >= 4).select("form", "given", "company", "skel", F.explode(deleted(F.col("given"))).alias("v"))
    a, b = (index.select(F.col("form").alias(s), F.col("given").alias(f"g{s}"), "company", "skel", "v") for s in ("a", "b"))
    return a.join(b, ["company", "skel", "v"]).where((F.col("a") < F.col("b")) & near(F.col("ga"), F.col("gb"))).select("a", "b")


def candidates(full: DataFrame) -> DataFrame:
    """(a, b) of the forms that suffixes bring together, common suffixes refined."""
    pairs, many = by_suffix(full)
    many = cut(many)
    tokens = full.select("form", "company", "skel", F.explode("alts").alias("alt")).withColumn("suffix", suffix(F.col("alt")))
    given = tokens.join(many, ["company", "suffix"], "left_semi").select("form", "company", "skel", "alt")
    sur = full.withColumn("suffix", suffix(F.col("skel"))).join(many, ["company", "suffix"], "left_semi")
    return pairs.unionByName(same_given(given)).unionByName(same_surname(sur))


def form_of() -> Column:
    return digest(F.col("company"), F.col("given"), F.col("sur"))


def persons(f: DataFrame) -> DataFrame:
    """(form, person): the person of each form, of ``f`` with form, company, given, sur and keys."""
    spelled = f.groupBy("form").agg(*[F.first(c).alias(c) for c in ("company", "given", "sur", "skel", "alts")], F.count(F.lit(1)).alias("n_rows"))
    spelled = cut(spelled)
    counts = spelled.groupBy("given").agg(F.sum("n_rows").alias("n_given"))
    full = cut(spelled.where(F.char_length("given") > 1).join(counts, "given"))
    shared = F.explode_outer(F.array(F.when(F.col("mailbox").isNotNull(), F.concat(F.lit("m:"), "mailbox")), F.when(F.col("slug").isNotNull(), F.concat(F.lit("p:"), "slug"))))
    linked = f.where(F.char_length("given") > 1).select("form", "company", shared.alias("k")).where(F.col("k").isNotNull()).distinct()
    # Only what several forms share is compared.
    several = linked.groupBy("company", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("company", "k")
    linked = cut(linked.join(several, ["company", "k"]))
    a, b = linked.select(F.col("form").alias("a"), "company", "k"), linked.select(F.col("form").alias("b"), "company", "k")
    pairs = a.join(b, ["company", "k"]).where(F.col("a") < F.col("b")).select("a", "b", F.lit(True).alias("linked"))
    pairs = pairs.unionByName(candidates(full).withColumn("linked", F.lit(False)))
    pairs = pairs.groupBy("a", "b").agg(F.max("linked").alias("linked"))
    side = lambda s: full.select(F.col("form").alias(s), F.col("given").alias(f"g{s}"), F.col("skel").alias(f"s{s}"), F.col("n_given").alias(f"n{s}"), F.col("alts").alias(f"alts_{s}"))
    edges = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_judge, "a binary, b binary")
    labels = propagate(cut(edges))
    known = cut(full.join(labels.withColumnRenamed("v", "form"), "form", "left").withColumn("person", F.coalesce("label", "form")))
    # Forms with an initial: the only person of that company, surname and initial.
    short = spelled.where(F.char_length("given") == 1).select("form", "company", "skel", F.col("given").alias("initial"))
    fits = known.select("company", "skel", F.explode_outer(F.array_distinct(F.transform("alts", lambda x: F.substring(x, 1, 1)))).alias("initial"), "person")
    only = fits.groupBy("company", "skel", "initial").agg(F.min("person").alias("person"), F.max("person").alias("other"))
    joined = short.join(only, ["company", "skel", "initial"], "left")
    # One that fits nobody stands for itself, together with the same initial and sound; one that fits several stays alone.
    own = digest(F.lit("i"), F.col("company"), F.col("skel"), F.col("initial"))
    joined = joined.select("form", F.when(F.col("person").isNull(), own).when(F.col("person") == F.col("other"), F.col("person")).otherwise(own).alias("person"))
    return known.select("form", "person").unionByName(joined)


def row_pairs(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seq_a, seq_b) of all rows of (seq, thing) with one thing, the pairs of many rows made chunk by chunk."""
    sizes = members.groupBy("thing").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).where(F.col("chunks") > 0)
    m = members.join(sizes, "thing").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("chunks")).cast("int"))
    all_parts = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    a = m.select("thing", F.col("seq").alias("seq_a"), F.col("part").alias("pa"), all_parts.alias("pb"))
    b = m.select("thing", F.col("seq").alias("seq_b"), all_parts.alias("pa"), F.col("part").alias("pb"))
    return a.join(b, ["thing", "pa", "pb"]).where(F.col("seq_a") < F.col("seq_b")).select("seq_a", "seq_b")


@scoped
def members(leads: DataFrame, key: str = "seq") -> DataFrame:
    """(seq, thing): the person, or organisation, that each row names: what ``link`` gives all pairs of, as one row each."""
    f = with_keys(forms(taken(leads, key, ""))).where(F.col("company").isNotNull())
    f = cut(f.withColumn("form", F.when(F.col("origin") == "n", form_of())))
    named = f.where(F.col("origin") == "n")
    who = cut(persons(named))
    people = named.join(who, "form").select(F.col("id").alias("seq"), F.concat(F.lit("p"), F.hex("person")).alias("thing"))
    organisations = f.where(F.col("bare")).select(F.col("id").alias("seq"), F.concat(F.lit("o"), "company").alias("thing"))
    return people.unionByName(organisations).distinct()


def link(leads: DataFrame, key: str = "seq") -> DataFrame:
    """(seq_a, seq_b) of every pair of rows that name the same person at the same company, or, without a person, the same organisation."""
    return row_pairs(members(leads, key))
