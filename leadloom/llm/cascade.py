"""Records of two tables that describe the same person, matched without a common key.

A deterministic cascade over the distinct names of the records (company, given name, surname; what has no whole name stands for itself). The strong rules
come first: a common mailbox, a common profile, the same name, each an exact join inside the company. What they link is one person, in either table or
across. A weaker rule (one edit in the surname, then in the given name, then an initial) is an exact join of the persons that are still open, those of one table only,
with all others: resolved ones are anti-joined away before. Resolved persons may still join each other in the two rules of typing errors, unless
something known contradicts it: profiles on both sides, or names that occur in both tables in either spelling.

The confidence of a rule is its labelled precision: of its pairs that are labelled, the share that is right, smoothed by (hits + 1) / (pairs + 2). Labels
are given as a table, or else taken from an attribute that the rule does not use, the strongest that both records have: profile, mailbox (initial and
longest part, as one person has several), name. Contradicting profiles count as a miss, whatever else agrees.

All pairs of one person come out, with the strongest rule that holds for the two records, or ``linked`` where only others connect them.

Defined results: null or repeated ids are left out or come once; a missing attribute joins nothing; a pair of two known companies that differ is never made;
an initial that fits several persons, and a short form of two names that both occur, are left open; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, scoped, small
from leadloom.llm import components
from leadloom.llm.people import digest, forms, one_edit, taken, variants, with_keys
from leadloom.operators.graph import propagate

#: From strong to weak.
RULES = ("mailbox", "profile", "name", "surname_typo", "given_typo", "initial")
#: Letters from which on a name may hold a typing error.
LONG = 4
#: Names that share a company and a given name, or a surname, up to which all of them are compared.
FEW = 16
#: Records of one person and table from which on its pairs are made in chunks.
CHUNK = 1_000


def _vertices(f: DataFrame) -> DataFrame:
    """(v, company, given, skel, alts, whole, l, r, paged): every vertex of the records, in which tables it occurs, and whether a profile of it is known."""
    side = lambda s: F.max(F.col("side") == s).alias(s)
    # All of what ``v`` is a number for: two vertices of one number would come out as two rows.
    own = ("v", "whole", "company", "given", "skel", "alts", F.when(~F.col("whole"), F.col("mailbox")).alias("own_mailbox"), F.when(~F.col("whole"), F.col("slug")).alias("own_slug"))
    return f.groupBy(*own).agg(side("l"), side("r"), F.max(F.col("slug").isNotNull()).alias("paged"))


def _firm(names: DataFrame) -> DataFrame:
    """(v, alt): what each name stands for. A short form of several names stands for the only one of them that occurs at its company with its
    surname, or for itself if none does; where several occur, for none."""
    one = names.where(F.size("alts") == 1).select("v", F.get("alts", F.lit(0)).alias("alt"))
    short = names.where(F.size("alts") > 1)
    meant = short.select("v", "company", "skel", F.explode("alts").alias("alt"))
    there = names.where(F.size("alts") == 1).select("company", "skel", F.get("alts", F.lit(0)).alias("alt")).distinct()
    found = meant.join(there, ["company", "skel", "alt"]).groupBy("v").agg(F.min("alt").alias("alt"), F.max("alt").alias("other"))
    settled = short.select("v", "given").join(found, "v", "left")
    alt = F.when(F.col("alt").isNull(), F.concat(F.lit("~"), "given")).when(F.col("alt") == F.col("other"), F.col("alt"))
    return one.unionByName(settled.select("v", alt.alias("alt")).where(F.col("alt").isNotNull()))


def _met(names: DataFrame, block: list[str], part: str) -> DataFrame:
    """(a, b) of the names of a block whose ``part`` are one edit apart.

    In a block of up to FEW names all pairs are compared; in a larger one those that share a name with a letter left out, which all that are one edit apart do.
    """
    sizes = names.groupBy(*block).agg(F.min(part).alias("lo"), F.max(part).alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("lo") != F.col("hi")).select(*block, "n")
    sized = cut(names.select("v", *block, F.col(part).alias("w")).join(sizes, block))

    def pairs(f: DataFrame, on: list[str]) -> DataFrame:
        a, b = (f.select(F.col("v").alias(s), F.col("w").alias(f"w{s}"), *on) for s in ("a", "b"))
        return a.join(b, on).where((F.col("a") < F.col("b")) & one_edit(F.col("wa"), F.col("wb"))).select("a", "b")

    many = sized.where(F.col("n") > FEW).withColumn("key", F.explode_outer(variants(F.col("w"))))
    return pairs(sized.where(F.col("n") <= FEW), block).unionByName(pairs(many, [*block, "key"])).distinct()


FLAGS = ("l", "r", "paged", "both", "named")


def _linked(labels: DataFrame, vertices: DataFrame, shared: DataFrame) -> DataFrame:
    """(v, person, and of the person: l, r, paged, both, named) of the vertices that are one person with another: in which tables it is, whether a profile of
    it is known, whether one of its names occurs in both tables, and whether any name of it is whole. Every other vertex is its own person."""
    at = cut(vertices.join(small(labels), "v").join(small(shared), "v", "left").select("v", F.col("label").alias("person"), "l", "r", "paged", F.coalesce("both", F.lit(False)).alias("both"), F.col("whole").alias("named")))
    known = at.groupBy("person").agg(*[F.max(x).alias(x) for x in FLAGS])
    return cut(at.select("v", "person").join(known, "person"))


def _or_own(df: DataFrame, linked: DataFrame, *flags: str) -> DataFrame:
    """``df`` (v and its own ``flags``) with ``person`` and the person's flags in their place."""
    found = df.join(small(linked.select("v", "person", *[F.col(x).alias(f"p_{x}") for x in flags])), "v", "left")
    kept = [c for c in df.columns if c not in flags]
    return found.select(*kept, F.coalesce("person", "v").alias("person"), *[F.coalesce(f"p_{x}", x).alias(x) for x in flags])


def _allowed(pairs: DataFrame, vertices: DataFrame, linked: DataFrame, shared: DataFrame, done: DataFrame) -> DataFrame:
    """The (a, b) of which a person is open, or which nothing contradicts; what an earlier weak rule resolved (``done``) is not open."""
    pairs = cut(pairs)
    ends = cut(pairs.select(F.explode_outer(F.array("a", "b")).alias("v")).distinct())
    p = vertices.select("v", "l", "r", "paged").join(small(ends), "v").join(small(shared), "v", "left").withColumn("both", F.coalesce("both", F.lit(False)))
    p = _or_own(p, linked, "l", "r", "paged", "both").join(small(done.withColumn("done", F.lit(True))), "v", "left")
    p = small(cut(p.select("v", "person", ((F.col("l") & F.col("r")) | F.col("done").isNotNull()).alias("resolved"), "paged", "both")))
    for s in ("a", "b"):
        pairs = pairs.join(p.select(F.col("v").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("person", "resolved", "paged", "both")]), s)
    apart = (F.col("a_paged") & F.col("b_paged")) | (F.col("a_both") & F.col("b_both"))
    return pairs.where((F.col("a_person") != F.col("b_person")) & (~(F.col("a_resolved") & F.col("b_resolved")) | ~apart)).select("a", "b")


def _numbered(f: DataFrame, seed: int) -> DataFrame:
    rest = [F.when(~F.col("whole"), F.coalesce(c, F.lit("\u0002"))) for c in ("mailbox", "slug")]
    return f.withColumn("v", F.xxhash64(F.lit(seed), F.col("whole"), *[F.coalesce(c, F.lit("\u0002")) for c in ("company", "given", "skel")], *rest))


def _records(raw: DataFrame, directory: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The records of both tables in comparable form, with the number ``v`` of the vertex they stand for, and the vertices. An initial
    may be anyone's: it is told apart by what else the record has."""
    f = with_keys(forms(taken(raw, key, "l").unionByName(taken(directory, key, "r"))))
    whole = F.col("company").isNotNull() & F.col("skel").isNotNull() & (F.char_length("given") > 1)
    f = f.select("id", "side", "company", "given", "skel", "alts", "mailbox", "slug", F.coalesce(whole, F.lit(False)).alias("whole"))
    f = f.where(F.col("whole") | F.col("mailbox").isNotNull() | F.col("slug").isNotNull() | (F.col("company").isNotNull() & F.col("skel").isNotNull() & F.col("given").isNotNull()))
    seed = 42
    f = cut(_numbered(f, seed))
    while True:
        vertices = cut(_vertices(f))
        # A number that stands for two vertices: another seed has none, most likely.
        if vertices.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
            return f, vertices
        seed += 1
        f = cut(_numbered(f.drop("v"), seed))


def resolve(f: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, person, l, r) of the vertices of ``_records``: the person each of them is, and the tables that person is in."""
    names = vertices.where("whole").select("v", "company", "given", "skel", "alts", "l", "r")
    firm = cut(_firm(names).join(names.select("v", "company", "given", "skel", "l", "r"), "v"))
    # Strong rules, inside the company.
    at = lambda kind, c: F.when(F.col(c).isNotNull(), digest(F.lit(kind), F.coalesce("company", F.lit("")), F.col(c)))
    keyed = f.select(F.col("v").alias("id"), F.explode_outer(F.array(at("m", "mailbox"), at("p", "slug"))).alias("key")).where(F.col("key").isNotNull())
    keyed = keyed.unionByName(firm.select(F.col("v").alias("id"), digest(F.lit("n"), F.col("company"), F.col("alt"), F.col("skel")).alias("key")))
    edges = cut(components.stars(keyed).distinct())
    labels = propagate(edges)
    in_both = firm.groupBy("company", "alt", "skel").agg(F.max("l").alias("l"), F.max("r").alias("r")).where(F.col("l") & F.col("r")).select("company", "alt", "skel")
    shared = cut(firm.join(in_both, ["company", "alt", "skel"]).select("v", F.lit(True).alias("both")).dropDuplicates(["v"]))
    linked = _linked(labels, vertices, shared)
    # Typing errors: the surname under one given name, then the given name under one surname.
    none = vertices.select("v").limit(0)
    typos = cut(_allowed(_met(firm.where(F.char_length("skel") >= LONG), ["company", "alt"], "skel"), vertices, linked, shared, none))
    done = cut(typos.select(F.explode_outer(F.array("a", "b")).alias("v")).distinct())
    more = cut(_allowed(_met(names.where(F.char_length("given") >= LONG), ["company", "skel"], "given"), vertices, linked, shared, done))
    edges = cut(edges.unionByName(typos).unionByName(more))
    linked = _linked(propagate(edges), vertices, shared)
    # Initials of persons without a whole name: the only person of the company, surname and initial, or at least the only one in the table they are not in.
    short = vertices.where(~F.col("whole") & (F.char_length("given") == 1) & F.col("company").isNotNull() & F.col("skel").isNotNull()).select("v", "company", "skel", F.col("given").alias("initial"), "l", "r", F.lit(False).alias("named"))
    open_ = cut(_or_own(short, linked, "l", "r", "named").where(~F.col("named")).select("v", "company", "skel", "initial", "l", "r"))
    fits = firm.select("v", "company", "skel", F.substring(F.translate("alt", "~", ""), 1, 1).alias("initial"), "l", "r")
    fits = _or_own(fits.join(small(cut(open_.select("company", "skel", "initial").distinct())), ["company", "skel", "initial"]), linked, "l", "r")
    ends = lambda n, c: [F.min(F.when(c, F.col("person"))).alias(f"{n}_lo"), F.max(F.when(c, F.col("person"))).alias(f"{n}_hi")]
    fits = fits.groupBy("company", "skel", "initial").agg(*ends("all", F.lit(True)), *ends("l", F.col("l")), *ends("r", F.col("r")))
    one = lambda n: F.when(F.col(f"{n}_lo") == F.col(f"{n}_hi"), F.col(f"{n}_lo"))
    fitted = open_.join(fits, ["company", "skel", "initial"]).select("v", F.coalesce(one("all"), F.when(~F.col("r"), one("r")), F.when(~F.col("l"), one("l"))).alias("lo")).where(F.col("lo").isNotNull())
    fitted = fitted.select(F.least("v", "lo").alias("a"), F.greatest("v", "lo").alias("b")).where(F.col("a") != F.col("b"))
    linked = _linked(components.label_graph(edges.unionByName(fitted)), vertices, shared)
    return _or_own(vertices.select("v", "l", "r"), linked, "l", "r")


def _pairs(f: DataFrame, people: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every record of the left table beside every one of the right table that is the same person, attributes with them."""
    both = small(cut(people.where(F.col("l") & F.col("r")).select("v", "person")))
    m = cut(f.select("id", "side", "v", "company", "given", "skel", "alts", "mailbox", "slug").join(both, "v").drop("v"))
    sizes = m.groupBy("person").agg(F.ceil(F.count_if(F.col("side") == "l") / chunk).cast("int").alias("c_l"), F.ceil(F.count_if(F.col("side") == "r") / chunk).cast("int").alias("c_r"))
    m = m.join(sizes, "person")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ("company", "given", "skel", "alts", "mailbox", "slug")
    a = m.where(F.col("side") == "l").select("person", F.col("id").alias("l"), *[F.col(c).alias(f"l_{c}") for c in cols], part("c_l").alias("p"), every("c_r").alias("q"))
    b = m.where(F.col("side") == "r").select("person", F.col("id").alias("r"), *[F.col(c).alias(f"r_{c}") for c in cols], every("c_l").alias("p"), part("c_r").alias("q"))
    return a.join(b, ["person", "p", "q"])


def _rule() -> Column:
    """The strongest rule that holds for a pair."""
    same = lambda c: F.col(f"l_{c}") == F.col(f"r_{c}")
    shared = F.arrays_overlap("l_alts", "r_alts")
    initial = (F.char_length("l_given") == 1) | (F.char_length("r_given") == 1)
    return (
        F.when(same("mailbox"), "mailbox").when(same("slug"), "profile").when(same("company") & same("skel") & shared & ~initial, "name")
        .when(same("company") & shared & ~initial & one_edit(F.col("l_skel"), F.col("r_skel")), "surname_typo").when(same("company") & same("skel") & ~initial & one_edit(F.col("l_given"), F.col("r_given")), "given_typo")
        .when(same("company") & same("skel") & initial, "initial").otherwise("linked")
    )


def _label() -> Column:
    """Whether a pair is right, by the strongest attribute that its rule does not use and both records have; else null."""

    def mail(c: str) -> Column:
        local = F.substring_index(c, "@", 1)
        longest = F.array_max(F.transform(F.split(local, "[._+-]"), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
        return F.concat(F.substring(local, 1, 1), longest)

    name = lambda s: F.concat_ws(" ", F.substring(f"{s}_given", 1, 1), F.substring(f"{s}_skel", 1, 4))
    both = F.col("l_given").isNotNull() & F.col("r_given").isNotNull()
    page = F.when(F.col("rule") != "profile", F.col("l_slug") == F.col("r_slug"))
    return F.coalesce(page, F.when(F.col("rule") != "mailbox", mail("l_mailbox") == mail("r_mailbox")), F.when(F.col("rule").isin("mailbox", "profile") & both, name("l") == name("r")))


@scoped
def match(raw: DataFrame, directory: DataFrame, key: str = "seq", labels: DataFrame | None = None) -> DataFrame:
    """(raw_seq, directory_seq, rule, confidence) of every pair about the same person at the same company. ``labels``: (raw_seq, directory_seq, same)
    of judged pairs, which the precision of the rules is then taken from."""
    f, vertices = _records(raw, directory, key)
    pairs = _pairs(f, resolve(f, vertices)).withColumn("rule", _rule()).withColumn("label", _label() if labels is None else F.lit(None).cast("boolean"))
    # A record that comes twice has its strongest rule.
    rank = F.array_position(F.lit([*RULES, "linked"]), F.col("rule"))
    pairs = pairs.select(F.col("l").alias("raw_seq"), F.col("r").alias("directory_seq"), rank.cast("int").alias("rank"), "label")
    pairs = cut(pairs.groupBy("raw_seq", "directory_seq").agg(F.min("rank").alias("rank"), F.max("label").alias("label")).withColumn("rule", F.element_at(F.lit([*RULES, "linked"]), F.col("rank"))))
    if labels is not None:
        pairs = cut(pairs.drop("label").join(labels.select("raw_seq", "directory_seq", F.col("same").cast("boolean").alias("label")), ["raw_seq", "directory_seq"], "left"))
    told = pairs.groupBy("rule").agg(F.count_if("label").alias("hits"), F.count("label").alias("n"))  # a row per rule
    confidence = told.select("rule", ((F.col("hits") + 1) / (F.col("n") + 2)).alias("confidence"))
    return pairs.join(F.broadcast(confidence), "rule").select("raw_seq", "directory_seq", "rule", "confidence")
