"""Who a contact row is about: its company and its person in forms that can be compared.

A company is known by its registrable host (of the domain cell, the website, or the mailbox, if that host is a company's): the label before the public suffix, with it. Under the
suffixes that nobody can register (RFC 2606) the label alone counts. Hosts of one label with different suffixes are one company if rows of both carry
the same company name. A row without a host gets the company that rows of the same company name carry, then of a name one edit away, then of the only
company with that first word, then of the rows with its mailbox or profile. A person is a given name and a surname without titles,
letters case and accents; order is mended by what is mostly a given name in the data, initials by the row's mailbox and profile.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, lookup
from leadloom.llm.keys import ADDRESS, mailbox, personal, profile
from leadloom.llm.mojibake import candidates
from leadloom.operators.graph import propagate
from leadloom.values import PLACEHOLDERS, looked_up, present, trimmed

# Suffixes that nobody can register (RFC 2606), and second levels that are public under the countries' suffixes.
RESERVED = ("example", "test", "invalid", "localhost")
SECOND_LEVEL = ("ac", "co", "com", "edu", "gen", "go", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
HOST = (
    "^(?:[a-z][a-z0-9+.-]*:/*)?(?:[^/?#@]*@)?(?:[\\p{L}\\p{N}_-]+\\.)*?([\\p{L}\\p{N}-]+\\.(?:(?:" + "|".join(SECOND_LEVEL) + ")\\.[a-z]{2}|\\p{L}{2,}))\\.?(?::\\d+)?(?:[/?#].*)?$"
)
# Legal forms and other words that do not tell companies apart.
LEGAL = frozenset(
    "gmbh corp corporation inc incorporated ltd limited ltda sl srl sas kk ab aktiebolag as jsc llc plc sa ag bv nv oy co company spzoo spa pte pty holding branch the".split()
)
LEGAL_PHRASES = tuple(f" {p} " for p in ("joint stock company", "sp z oo", "sp zoo", "a s", "g m b h"))
# Titles, degrees and remarks around a person's name.
AROUND = frozenset("mr mrs ms miss mx dr prof sir dame mba phd md bsc msc she he they her him them hiring jr sr ii iii".split())
# Names of departments given where a person is expected.
DEPARTMENTS = frozenset(
    "support sales info office reception admin administration marketing procurement purchasing accounting accounts billing hr it team desk helpdesk service services customer department contact hello finance operations press legal engineering".split()
)
# Nicknames and what they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alexandra", "andy": "andrew", "becky": "rebecca", "ben": "benjamin", "beppe": "giuseppe", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "charlie": "charles", "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "drew": "andrew", "ed": "edward", "eddie": "edward",
    "fred": "frederick", "greg": "gregory", "hannes": "johannes", "jack": "john", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph",
    "joey": "joseph", "jon": "jonathan", "kasia": "katarzyna", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kit": "christopher", "larry": "lawrence",
    "liz": "elizabeth", "lizzie": "elizabeth", "lola": "dolores", "lupe": "guadalupe", "maggie": "margaret", "matt": "matthew", "max": "maximilian", "meg": "margaret",
    "mick": "michael", "mike": "michael", "nick": "nicholas", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "peggy": "margaret", "pete": "peter",
    "rich": "richard", "rick": "richard", "rike": "friederike", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "sandy": "alexander alexandra sandra",
    "sepp": "josef", "steve": "stephen steven", "sue": "susan", "suzie": "susan", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas",
    "toni": "anton antonia", "tony": "anthony", "tori": "victoria", "trish": "patricia", "vicky": "victoria", "will": "william", "wolf": "wolfgang",
}
# Letters that Unicode decomposition leaves whole, and Cyrillic ones as names are romanised.
LETTERS = str.maketrans(
    {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"}
    | dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh sch _ y _ e yu ya".replace("_", "").split(" "), strict=True))
    | {"і": "i", "ї": "i", "є": "e", "ґ": "g"}
)


_ALONE = re.compile("(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")


@lru_cache(maxsize=65_536)
def repaired(text: str) -> str:
    """The text of the shortest lossless chain back to well-formed UTF-8, if there is one; names are matched, not restored, with it."""
    if text.isascii() or _ALONE.search(text):  # what was UTF-8 comes in runs of two and more
        return text
    back = [t for chain, t, whole in candidates(text) if whole and chain.endswith(":utf8") and all(c.isalpha() or c.isascii() or c in "’–º" for c in t)]
    return min(back, key=len) if back and len(min(back, key=len)) < len(text) else text


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text.casefold().translate(LETTERS))
    t = "".join(c for c in t if not unicodedata.combining(c))
    return t.translate(LETTERS)


def usable(text: str | None) -> str:
    t = " ".join((text or "").split())
    return "" if t.casefold() in PLACEHOLDERS else t


@lru_cache(maxsize=65_536)
def company_words(name: str | None) -> str:
    """The words of a company name without legal form, a part behind a comma in front of the rest."""
    t = fold(repaired(usable(name))).replace(".", "").replace("&", " and ").replace("’", "").replace("'", "")
    parts = []
    for p in t.split(","):
        p = f" {' '.join(re.sub(r'[^\w]+', ' ', p).split())} "
        for phrase in LEGAL_PHRASES:
            if p.endswith(phrase) and len(p) > len(phrase):
                p = p[: 1 - len(phrase)]
        words = [w for w in p.split()]
        kept = [w for w in words if w not in LEGAL] if len(words) > 1 or len(parts) else words
        if kept:
            parts.append((kept, len(kept) < len(words)))
    if len(parts) == 2 and parts[1][0]:
        return " ".join(parts[1][0] + parts[0][0])
    return " ".join(w for p, _ in parts for w in p)


def skeleton(word: str) -> str:
    """A surname as it sounds: interchangeable letters alike, doubled ones once."""
    w = re.sub(r"[^\w]", "", word).replace("ph", "f").translate(str.maketrans("wyczj", "viksi"))
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(maxsize=262_144)
def _word(raw: str) -> str:
    """A word of a name; an initial stays one letter, however it is romanised."""
    w = re.sub(r"[^\w-]", "", fold(raw))
    return w[:1] if len(re.sub(r"\W", "", raw)) == 1 else w


@lru_cache(maxsize=262_144)
def _around(raw: str) -> bool:
    return fold(raw).strip(".!") in AROUND


def name_parts(full: str | None, first: str | None, last: str | None) -> tuple[list[str], list[str]] | None:
    """The words before and behind in a name, in the order given name, surname as far as its form shows it."""
    text = repaired(usable(full))
    if "(" in text:
        text = re.sub(r"\(.*?\)", " ", text)
    a, b = usable(first), usable(last)
    if a and b and (not text or re.search(r"[^\w\s.,'’!/-]", text)):  # no full name, or one that is beyond repair
        given, sur = ([w for w in map(_word, repaired(x).split()) if w and w not in AROUND] for x in (a, b))
        given, sur = ([w for w in x if len(w) > 1] or x for x in (given, sur))
        return ([" ".join(given)], sur) if given and sur and not all(w in DEPARTMENTS for w in given + sur) else None
    if not text:
        return None
    swapped = False
    if "," in text:
        halves = [h for h in text.split(",") if not all(map(_around, h.split()))]
        swapped = len(halves) == 2
        text = f"{halves[1]} {halves[0]}" if swapped else " ".join(halves)
    raw = [w for w in text.split() if not _around(w) and re.search(r"\w", w)]
    if not swapped and raw and raw[0].isupper():
        upper = [w.isupper() and len(w) > 1 and "." not in w for w in raw]
        if upper[0] and not all(upper) and not upper[-1]:
            n = upper.index(False)
            raw = raw[n:] + raw[:n]
    words = [w for w in map(_word, raw) if w]
    if len(words) > 2:
        words = [words[0], *[w for w in words[1:-1] if len(w) > 1], words[-1]]
    if len(words) < 2 or all(w in DEPARTMENTS for w in words):
        return None
    return words[:1], words[1:]


def parse(first, last, full, email, slug) -> tuple:
    """given, surname, where the name is from (n: name fields, e: mailbox or profile)."""
    parts = name_parts(full, first, last)
    local = re.split(r"[._+-]+", email.split("@")[0]) if email else []
    local = [fold(w) for w in local if w and not w.isdigit()]
    page = [fold(w) for w in slug.split("-") if w] if slug else []
    if parts:
        given, sur = parts[0][0], " ".join(parts[1])
        if len(sur) == 1 and len(given) > 1:  # "Smith J."
            given, sur = sur, given
        if len(given) == 1:
            plain_sur = re.sub(r"[^\w]", "", sur)
            for words in (page, local):
                for w in words[:2]:
                    if len(w) > 2 and w[0] == given and w != plain_sur and any(skeleton(x)[:4] == skeleton(plain_sur)[:4] for x in words if x != w):
                        return w, sur, "n"
        return given, sur, "n"
    if len(page) >= 2 and len(page[0]) > 1 and len(page[1]) > 2:
        return page[0], page[1], "e"
    if len(local) == 2 and max(map(len, local)) > 2:
        a, b = local
        return (b, a, "e") if len(b) == 1 else (a, b, "e")
    return None, None, None


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = {c: b.column(c).to_pylist() for c in ("first_name", "last_name", "full_name", "mailbox", "slug", "company_name")}
        names = [parse(*x) for x in zip(*list(cells.values())[:5])]
        kept = [c for c in b.schema.names if c not in ("first_name", "last_name", "full_name", "company_name")]
        made = {"company_words": [company_words(c) or None for c in cells["company_name"]], "given": [n[0] for n in names], "sur": [n[1] for n in names], "origin": [n[2] for n in names]}
        yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(v, pa.string()) for v in made.values()], names=kept + list(made))


def host_key(c: Column | str) -> Column:
    """The registrable host of a domain, page or mailbox; under a reserved suffix its label."""
    h = F.regexp_extract(F.lower(trimmed(c)), HOST, 1)
    reserved = F.substring_index(h, ".", -1).isin(*RESERVED)
    return F.when(reserved, F.substring_index(h, ".", 1)).when(h != "", h)


def variants(c: Column) -> Column:
    """A text and what it is with one letter left out: two texts share one if they are an edit apart."""
    left_out = F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.char_length(c))))
    return F.array_distinct(F.concat(F.array(c), left_out))


def one_edit(a: Column, b: Column) -> Column:
    same = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    far = F.levenshtein(a, b)
    return (far <= 1) | ((far == 2) & same & (F.char_length(a) == F.char_length(b)))


#: Letters of the suffixes that names are indexed by, and the ratio of the longest common subsequence from which on they are spellings of one.
SUFFIX = 4
RATIO = 0.85


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def digest(*parts: Column) -> Column:
    """128 bits that stand for the parts."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def suffix(token: Column) -> Column:
    """The suffix that a token is indexed by; a short token is its own. Tokens that share a longer suffix share this one."""
    return F.when(F.char_length(token) > SUFFIX, F.substring(token, -SUFFIX, SUFFIX)).otherwise(token)


def _same_firm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [min(ratio(x, y), ratio(x.split(" ")[0], y.split(" ")[0])) >= RATIO for x, y in zip(b.column("company_words").to_pylist(), b.column("known").to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_())).select(["company_words", "label"])


def _by_suffix(rest: DataFrame, known: DataFrame) -> DataFrame:
    """(company_words, label) of the names that share a word's suffix with names of one company only, and are within RATIO of one.

    A suffix alone (of ``foods``, ``systems``) is common to names of all kinds: it counts together with the first letters of the name.
    """
    first = lambda c: F.substring_index(c, " ", 1)
    keys = lambda c: F.array_distinct(F.concat(F.array(F.concat(F.lit("1"), F.substring(c, 1, 3), suffix(first(c)))), F.transform(F.filter(F.split(c, " "), lambda w, i: i > 0), lambda w: F.concat(F.lit("2"), F.substring(c, 1, 3), suffix(w)))))
    a = rest.where(F.char_length(first(F.col("company_words"))) >= 6).select("company_words", F.explode_outer(keys(F.col("company_words"))).alias("key"))
    b = known.where(F.char_length(first(F.col("company_words"))) >= 6).select(F.col("company_words").alias("known"), "label", F.explode_outer(keys(F.col("company_words"))).alias("key"))
    met = a.join(b, "key").where(F.levenshtein("company_words", "known") <= (1 - RATIO) * (F.char_length("company_words") + F.char_length("known")) + 1e-9)
    judged = met.select("company_words", "known", "label").distinct().mapInArrow(_same_firm, "company_words string, label string")
    return judged.groupBy("company_words").agg(F.min("label").alias("label"), F.max("label").alias("other")).where(F.col("label") == F.col("other")).select("company_words", "label")


def _named(forms: DataFrame) -> DataFrame:
    """(company_words, label) of company names whose rows carry a label: the most frequent one."""
    seen = forms.where(F.col("label").isNotNull() & F.col("company_words").isNotNull()).groupBy("company_words", "label").agg(F.count(F.lit(1)).alias("n"))
    best = seen.groupBy("company_words").agg(F.max(F.struct("n", "label")).alias("b"))
    return best.select("company_words", F.col("b.label").alias("label"), F.col("b.n").alias("n"))


def _labels(forms: DataFrame) -> DataFrame:
    """(company_words, company) of every company name that rows without a label carry."""
    known = cut(_named(forms))
    # Near names are sought among those that are no slips of the pen themselves: a company's most frequent one, and every one that occurs again.
    usual = known.join(known.groupBy("label").agg(F.max("n").alias("most")), "label").where((F.col("n") > 1) | (F.col("n") == F.col("most"))).select("company_words", "label", "n")
    open_ = cut(forms.where(F.col("label").isNull() & F.col("company_words").isNotNull()).select("company_words").distinct())
    exact = open_.join(known, "company_words").select("company_words", "label")
    rest = cut(open_.join(exact, "company_words", "left_anti"))
    v_known = usual.select(F.col("company_words").alias("known"), "label", "n", F.explode_outer(variants(F.col("company_words"))).alias("v"))
    v_rest = rest.select("company_words", F.explode_outer(variants(F.col("company_words"))).alias("v"))
    near = v_rest.join(v_known, "v").where(one_edit(F.col("company_words"), F.col("known"))).groupBy("company_words").agg(F.max(F.struct("n", "label")).alias("b")).select("company_words", "b.label")
    near = cut(near)
    near = cut(near.unionByName(_by_suffix(rest.join(near, "company_words", "left_anti"), usual)))
    rest = cut(rest.join(near, "company_words", "left_anti").withColumn("core", F.substring_index("company_words", " ", 1)).where(F.char_length("core") >= 5))
    cores = known.groupBy(F.substring_index("company_words", " ", 1).alias("core")).agg(F.count_distinct("label").alias("k"), F.max("label").alias("label")).where((F.col("k") == 1) & (F.char_length("core") >= 5))
    cores = cut(cores.select("core", "label"))
    by_core = rest.join(cores, "core").select("company_words", "label")
    last = rest.join(cores, "core", "left_anti").select("company_words", "core", F.explode_outer(variants(F.col("core"))).alias("v"))
    v_cores = cores.select(F.col("core").alias("known"), "label", F.explode_outer(variants(F.col("core"))).alias("v"))
    by_near_core = last.join(v_cores, "v").where(one_edit(F.col("core"), F.col("known"))).groupBy("company_words").agg(F.min("label").alias("label"), F.max("label").alias("other")).where(F.col("label") == F.col("other")).select("company_words", "label")
    return exact.unionByName(near).unionByName(by_core).unionByName(by_near_core)


COLUMNS = ("first_name", "last_name", "full_name", "job_title", "seniority", "email", "phone", "linkedin_url", "company_name", "company_domain", "company_website")


def taken(rows: DataFrame, key: str, side: str) -> DataFrame:
    """The columns that are read, with ``id`` and ``side``, whatever else the table has; rows without an id are left out."""
    named = rows.where(F.col(key).isNotNull())
    return named.select(F.col(key).cast("long").alias("id"), F.lit(side).alias("side"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS])


def _one_company(f: DataFrame) -> DataFrame:
    """(label, company) of the hosts that other hosts of the same label share a company name with."""
    seen = f.where(F.col("label").contains(".") & F.col("company_words").isNotNull()).select(F.substring_index("label", ".", 1).alias("stem"), "company_words", "label").distinct()
    hubs = seen.groupBy("stem", "company_words").agg(F.min("label").alias("a"), F.max("label").alias("z")).where(F.col("a") != F.col("z"))
    edges = seen.join(hubs, ["stem", "company_words"]).where(F.col("label") != F.col("a")).select("a", F.col("label").alias("b")).distinct()
    return propagate(cut(edges)).select(F.col("v").alias("label"), F.col("label").alias("company"))


def forms(rows: DataFrame) -> DataFrame:
    """Of rows with the lead columns, ``id`` and ``side``: (id, side, company, given, sur, origin, mailbox, slug, bare).

    ``origin`` tells a name of the name fields (n) from one read off mailbox or profile (e); ``bare`` rows have no person field at all.
    """
    none = lambda c: present(c).isNull()
    bare = none("first_name") & none("last_name") & none("full_name") & none("job_title") & none("seniority") & none("email") & none("phone") & none("linkedin_url")
    flat = rows.select(
        "id", "side", "first_name", "last_name", "full_name", "company_name", host_key("company_domain").alias("own"), host_key("company_website").alias("site"),
        mailbox("email").alias("m"), profile("linkedin_url").alias("slug"), bare.alias("bare"),
    )
    flat = flat.select("id", "side", "first_name", "last_name", "full_name", "company_name", F.coalesce("own", "site").alias("label"), host_key(F.substring_index("m", "@", -1)).alias("mail_label"), personal(F.col("m")).alias("mailbox"), "slug", "bare")
    shape = "id long, side string, label string, mail_label string, mailbox string, slug string, bare boolean, company_words string, given string, sur string, origin string"
    f = cut(flat.mapInArrow(_forms, shape))
    # A mail host is a company's if rows that state a host of their own mostly state this one (hosts of free mailboxes are not), or, where no row tells, if others state it.
    told = F.explode_outer(F.array(F.struct(F.col("mail_label").alias("host"), (F.col("mail_label") == F.col("label")).cast("int").alias("same"), F.lit(0).alias("stated")), F.struct(F.col("label").alias("host"), F.lit(None).cast("int").alias("same"), F.lit(1).alias("stated")))).alias("t")
    mails = f.select(told).where(F.col("t.host").isNotNull()).groupBy("t.host").agg(F.avg("t.same").alias("share"), F.max("t.stated").alias("stated"))
    mails = cut(mails.where((F.coalesce("share", F.lit(1.0)) >= 0.5) & ((F.col("stated") == 1) | F.col("share").isNotNull())).select(F.col("host").alias("mail_label"), F.lit(True).alias("known")))
    # What is mostly a given name: words that stand first far more often than last.
    word = F.explode_outer(F.array(F.struct(F.col("given").alias("word"), F.lit(1).alias("a")), F.struct(F.col("sur").alias("word"), F.lit(0).alias("a")))).alias("w")
    usual = f.where(F.col("origin") == "n").select(word).groupBy("w.word").agg(F.sum("w.a").alias("n_first"), F.count(F.lit(1)).alias("n"))
    usual = cut(usual.where((F.col("n_first") >= 3) & (F.col("n_first") > 3 * (F.col("n") - F.col("n_first"))) & (F.char_length("word") > 1)).select("word"))
    f = lookup(f, mails, "mail_label").withColumn("label", F.coalesce("label", F.when(F.col("known"), F.col("mail_label")))).drop("known", "mail_label")
    f = lookup(f, _one_company(f), "label").withColumn("label", F.coalesce("company", "label")).drop("company")
    f = lookup(f, cut(_labels(f).select("company_words", F.col("label").alias("by_name"))), "company_words")
    f = f.withColumn("company", F.coalesce("label", "by_name")).drop("label", "by_name")
    f = lookup(f, usual.select(F.col("word").alias("given"), F.lit(True).alias("given_usual")), "given")
    f = lookup(f, usual.select(F.col("word").alias("sur"), F.lit(True).alias("sur_usual")), "sur")
    turn = F.col("sur_usual").isNotNull() & F.col("given_usual").isNull() & (F.char_length("given") > 1)
    return _by_keys(cut(f.select("id", "side", "company", "company_words", F.when(turn, F.col("sur")).otherwise(F.col("given")).alias("given"), F.when(turn, F.col("given")).otherwise(F.col("sur")).alias("sur"), "origin", "mailbox", "slug", "bare")))


def _by_keys(f: DataFrame) -> DataFrame:
    """Rows without a company take the only one of the rows with their mailbox, or else their profile; the others are known by their company name."""
    lost, own = f.where(F.col("company").isNull()), f.where(F.col("company").isNotNull())
    for key in ("mailbox", "slug"):
        met = own.join(lost.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")
        only = met.groupBy(key).agg(F.min("company").alias("only"), F.max("company").alias("other")).where(F.col("only") == F.col("other")).select(key, F.col("only").alias(f"by_{key}"))
        lost = lookup(lost, cut(only), key)
    by_name = F.when(F.col("company_words").isNotNull(), F.concat(F.lit("?"), "company_words"))
    lost = lost.withColumn("company", F.coalesce("by_mailbox", "by_slug", by_name)).drop("by_mailbox", "by_slug")
    return own.unionByName(lost).drop("company_words")


def with_keys(f: DataFrame) -> DataFrame:
    """Adds ``alts`` (the given name and what it may stand for), ``sur1`` (the surname's first part) and ``skel`` (how that sounds)."""
    # Nicknames are short: longer names need no look into the table.
    stands_for = F.when(F.char_length("given") <= max(map(len, NICKNAMES)), looked_up(F.col("given"), NICKNAMES))
    alts = F.when(stands_for.isNotNull(), F.split(stands_for, " ")).when(F.col("given").contains(" "), F.array_distinct(F.concat(F.split("given", " "), F.array("given")))).when(F.col("given").isNotNull(), F.array("given"))
    sur1 = F.regexp_replace(F.substring_index("sur", "-", 1), "[^\\p{L}\\p{N}]", "")
    sound = F.translate(F.regexp_replace(sur1, "ph", "f"), "wyczj", "viksi")
    return f.withColumn("alts", alts).withColumn("sur1", sur1).withColumn("skel", F.regexp_replace(sound, "(.)\\1+", "$1"))
