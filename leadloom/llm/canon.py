"""Free-entered values mapped to the entries of a reference list, the unmatched ones reported with 0.

An automaton over the canonical names and their aliases finds every mention inside a value in one pass; of overlapping mentions the
longest wins (then the leftmost), and the longest of those that remain decides. Values without a mention go to token-set similarity: their tokens are mended to
the vocabulary of the list by one edit, and compared as sets; before that, an alias one edit away from the whole value is taken.

Each distinct value is mapped once (the list is small and goes to the workers), and joined back to its rows.

Defined results: a missing value, or one already written exactly like an entry of its field, gives no row; equal similarities go to the smaller
``canon_id``; fields without entries are all unmatched; an entry repeated in the list counts with its smallest id; values are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, small
from leadloom.llm.mojibake import long_form
from leadloom.values import present

FIELDS = ("job_title", "company_country", "company_industry", "seniority")
#: Entries a list may have; more would not fit beside a worker's data.
MAX_ENTRIES = 1_000_000
SIMILAR = 0.75
#: Mentions of up to so many letters have to be all of a value but its trimmings.
SHORT = 3
#: Aliases this long or longer are also taken one edit away.
MENDED = 4

# Words around a value that say nothing about it.
TRIMMINGS = frozenset("country hq the of and interim dach emea apac latam mentor proud parent hiring".split())

# Spellings of the functions in job titles.
FUNCTIONS = {
    "Sales": ("sales",), "Marketing": ("marketing", "mktg"), "Engineering": ("engineering", "eng", "engr"), "Product": ("product", "prod"),
    "Operations": ("operations", "ops"), "Finance": ("finance", "fin"), "Human Resources": ("human resources", "hr", "human res"),
    "Customer Success": ("customer success", "cs", "cust success"), "Procurement": ("procurement", "proc", "purchasing"),
    "Information Technology": ("information technology", "it", "info tech", "information tech"),
}
# Spellings of the levels, and the forms a level and a function {f} make.
LEVELS = {
    "VP of {}": (("vp", "vice president", "v p"), ("{l} of {f}", "{l} {f}", "{f} {l}")),
    "Director of {}": (("director", "dir"), ("{l} of {f}", "{l} {f}", "{f} {l}")),
    "{} Manager": (("manager", "mgr"), ("{f} {l}", "{l} {f}", "{l} of {f}")),
}

# Other aliases of the entries, without case, accents and punctuation.
ALIASES = {
    "job_title": {
        "Chief Executive Officer": "ceo, chief executive, chief exec officer, pdg",
        "Chief Technology Officer": "cto, chief technical officer, chief tech officer",
        "Chief Financial Officer": "cfo, chief finance officer, director financiero",
        "Chief Operating Officer": "coo, chief operations officer, chief ops officer",
        "Chief Marketing Officer": "cmo, chief mktg officer",
        "Chief Information Officer": "cio, chief info officer",
        "Founder": "founding partner, co founder, cofounder, grunder, gruender, fundadora, fundador, fondateur, fondatrice",
        "Managing Director": "md, mng director, managing dir, geschaftsfuhrer, geschaeftsfuehrer",
        "Software Engineer": "swe, software eng, software developer, software dev, softwareentwickler",
        "Senior Software Engineer": "sr swe, snr swe, senior swe, sr software engineer, snr software engineer, sr software eng, snr software eng, senior software eng, senior software developer",
        "Data Scientist": "data sci, ds",
        "Data Analyst": "data anlst, analyst data, datenanalyst",
        "Account Executive": "ae, acct exec, account exec, acct executive",
        "Sales Development Representative": "sdr, sales dev rep, sales development rep, sales dev representative",
        "Executive Assistant": "ea, executive asst, exec assistant, exec asst",
        "Solutions Architect": "solution architect, sol architect, architect solutions",
        "Office Manager": "office mgr, mgr office, manager office",
        "Business Analyst": "ba, bus analyst, biz analyst, analyst business",
        "Intern": "internship, summer intern, stagiaire, praktikant, praktikantin, becario",
    },
    "company_country": {
        "United States": "us, usa, united states of america, estados unidos, etats unis, vereinigte staaten, america",
        "United Kingdom": "uk, gb, gbr, great britain, royaume uni, vereinigtes konigreich, reino unido, britain, england, scotland, wales, northern ireland",
        "Germany": "de, deu, ger, deutschland, allemagne, alemania, fed rep of germany, federal republic of germany",
        "France": "fr, fra, frankreich, francia, republic of france, french republic",
        "Spain": "es, esp, espana, spanien, espagne, kingdom of spain",
        "Italy": "it, ita, italia, italien, italie",
        "Netherlands": "nl, nld, the netherlands, holland, nederland, niederlande, pays bas",
        "Poland": "pl, pol, polska, polen, pologne",
        "Portugal": "pt, prt, portuguese republic",
        "Brazil": "br, bra, brasil, bresil, brasilien",
        "Mexico": "mx, mex, mexiko, mexique",
        "Canada": "ca, can, kanada",
        "Vietnam": "vn, vnm, viet nam",
        "Japan": "jp, jpn, nippon, nihon, 日本, japon",
        "South Korea": "kr, kor, s korea, republic of korea, korea republic of, sudkorea, 대한민국",
        "India": "in, ind, bharat, republic of india, indien",
        "Singapore": "sg, sgp, singapur, singapour",
        "Australia": "au, aus, australien, australie",
        "Sweden": "se, swe, sverige, schweden, suede",
        "Norway": "no, nor, norge, norwegen, norvege",
        "Denmark": "dk, dnk, danmark, danemark, dinamarca",
        "Switzerland": "ch, che, schweiz, suisse, svizzera",
        "Austria": "at, aut, osterreich, oesterreich, autriche",
        "Czechia": "cz, cze, czech republic, cesko, tschechien",
        "Turkey": "tr, tur, turkiye, turkei, turquie",
        "Ukraine": "ua, ukr, украіна, украина",
        "Iceland": "is, isl, island, islande",
        "Ireland": "ie, irl, eire, rep of ireland, republic of ireland, irland",
    },
    "company_industry": {
        "Software": "saas, software dev, software development, computer software, software and services",
        "Information Technology": "it, it services, info technology, information tech, info tech",
        "Manufacturing": "mfg, industrial manufacturing, fertigung",
        "Financial Services": "finserv, fin services, finance",
        "Insurance": "insurances, versicherung, versicherungen",
        "Healthcare": "health care, hospital and health care, gesundheitswesen",
        "Pharmaceuticals": "pharma, pharmaceutical",
        "Retail": "retailing, retail trade, einzelhandel",
        "Logistics": "logistik, transport and logistics, logistics and supply chain",
        "Construction": "bau, construccion, building and construction",
        "Real Estate": "realestate, immobilien, property real estate, property",
        "Education": "edu, bildung, higher education",
        "Telecommunications": "telco, telecom, telecoms",
        "Energy": "energie, power and energy, oil and energy",
        "Agriculture": "agri, landwirtschaft, farming and agriculture",
        "Hospitality": "hospitality industry, hotels and hospitality",
        "Automotive": "auto, automobile, automotive industry",
        "Aerospace": "aero space, aviation and aerospace",
        "Media": "medien, media and publishing",
        "Advertising": "publicidad, advertising services, marketing and advertising",
        "Legal Services": "law, legal, law practice",
        "Food and Beverage": "f and b, food bev, food beverage",
        "Staffing and Recruiting": "recruitment, recruiting, staffing, personalvermittlung",
        "Nonprofit": "ngo, non profit, non profit organization",
    },
    "seniority": {
        "founder": "owner, co founder, cofounder, founding, partner",
        "c_suite": "c suite, csuite, cxo, c level, chief, executive, ceo, cto, cfo, coo, cmo, cro, cio, cpo",
        "vp": "vice president, evp, svp, v p",
        "director": "dir, directeur, direktor, head",
        "manager": "mgr, team lead, lead, mid management",
        "senior": "sr, snr, senior level, principal, staff",
        "entry": "entry level, junior, jr, associate",
        "intern": "internship, trainee, working student",
    },
}

_CUTS = re.compile(r"\s(?:at|@|-|–|—|\||&)\s|\s*[(|@]|\s-$", re.IGNORECASE)


def plain(text: str) -> str:
    """Words without case, accents and punctuation; dots close up, so that an abbreviation is one word."""
    t = unicodedata.normalize("NFKD", text.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("&", " and ").replace(".", "")
    return " ".join(re.sub(r"[\W_]+", " ", t).split())


def aliases_of(field: str, canonical: str) -> list[str]:
    """Every spelling of an entry: its own, those of the table, those its level and function make."""
    found = [plain(canonical), *(plain(a) for a in ALIASES.get(field, {}).get(canonical, "").split(","))]
    if field == "job_title":
        for level, (words, forms) in LEVELS.items():
            for function, spellings in FUNCTIONS.items():
                if level.format(function) == canonical:
                    found += [f.format(l=w, f=s) for w in words for s in spellings for f in forms]
    return [a for a in dict.fromkeys(found) if a]


def shortened(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """Equal but for one letter put in, left out or replaced, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class Near:
    """Words within one edit, looked up by what they are with one letter left out."""

    def __init__(self, words):
        self.by: dict[str, list[str]] = {}
        for w in words:
            if len(w) >= MENDED:
                for s in (w, *shortened(w)):
                    self.by.setdefault(s, []).append(w)

    def __call__(self, word: str) -> list[str]:
        seen = dict.fromkeys(w for s in (word, *shortened(word)) for w in self.by.get(s, ()))
        return [w for w in seen if one_edit(word, w)]


class Matcher:
    """The entries of one field."""

    def __init__(self, field: str, entries: list[tuple[int, str]], more: dict[str, list[str]] | None = None):
        import ahocorasick

        self.of: dict[str, int] = {}
        for i, canonical in sorted(entries):
            for a in [*aliases_of(field, canonical), *filter(None, map(plain, (more or {}).get(canonical, ())))]:
                self.of.setdefault(a, i)
        self.automaton = ahocorasick.Automaton()
        for a, i in self.of.items():
            self.automaton.add_word(f" {a} ", (len(a), i))
        if self.of:
            self.automaton.make_automaton()
        self.near = Near(self.of)
        self.words = {w for a in self.of for w in a.split()}
        self.near_word = Near(self.words)
        self.sets: dict[str, list[tuple[frozenset, int]]] = {}
        for a, i in self.of.items():
            s = frozenset(a.split()) - TRIMMINGS or frozenset(a.split())
            for w in s:
                self.sets.setdefault(w, []).append((s, i))

    def mention(self, text: str) -> tuple[int, int] | None:
        """Length and (negative) id of the alias that decides."""
        if not self.of:
            return None
        # An alias stands between blanks; a hit ends with the blank behind it.
        hits = [(n, end - n, i) for end, (n, i) in self.automaton.iter(f" {text} ")]
        found: list[tuple[int, int, int]] = []
        for n, start, i in sorted(hits, key=lambda h: (-h[0], h[1], h[2])):
            if all(start >= s + k or start + n <= s for k, s, _ in found):
                found.append((n, start, i))
        rest = sum(len(w) for w in text.split() if w not in TRIMMINGS)
        return next(((n, -i) for n, _, i in found if n > SHORT or rest <= n), None)

    def by_tokens(self, text: str) -> int | None:
        words = []
        for w in text.split():
            if w in self.words or w in TRIMMINGS:
                words.append(w)
            else:
                words.append(min(self.near_word(w), default=w))
        mine = frozenset(words) - TRIMMINGS
        best: tuple[float, int] | None = None
        for w in mine:
            for s, i in self.sets.get(w, ()):
                score = len(s & mine) / len(s | mine)
                if score >= SIMILAR and (best is None or (-score, i) < (-best[0], best[1])):
                    best = score, i
        return best[1] if best else None

    def __call__(self, value: str) -> int:
        value = unicodedata.normalize("NFKC", value)
        heads = [value, *(value[: m.start()] for m in _CUTS.finditer(value) if value[: m.start()].strip()), *([value.rpartition(",")[0]] if "," in value else [])]
        texts = [t for t in dict.fromkeys(" ".join(w for w in plain(h).split() if w not in ("country", "hq")) for h in heads) if t]
        for t in texts:
            if t in self.of:
                return self.of[t]
        # A typing error in the longer of two aliases must not leave the shorter one inside it.
        found = [m for t in texts if (m := self.mention(t))]
        found += [(len(a), -self.of[a]) for t in texts for a in self.near(t)]
        if found:
            return -max(found)[1]
        for t in texts:
            if (i := self.by_tokens(t)) is not None:
                return i
        return 0


def match(rows: DataFrame, canon: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "seq", aliases: DataFrame | None = None) -> DataFrame:
    """(key, field, value, canon_id) of every value that is present and not already an entry. ``aliases``: (field, canonical, alias) beside the table of this module,
    for other lists; as many as a list may have entries."""
    entries = canon.select("canon_id", "field", "canonical").dropna().limit(MAX_ENTRIES + 1).collect()
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"a reference list may have {MAX_ENTRIES} entries")
    lists: dict[str, list[tuple[int, str]]] = {f: [] for f in fields}
    for r in entries:
        if r["field"] in lists:
            lists[r["field"]].append((r["canon_id"], r["canonical"]))

    more: dict[str, dict[str, list[str]]] = {f: {} for f in fields}
    if aliases is not None:
        given = aliases.select("field", "canonical", "alias").dropna().limit(MAX_ENTRIES + 1).collect()
        if len(given) > MAX_ENTRIES:
            raise ValueError(f"a reference list may have {MAX_ENTRIES} aliases")
        for r in given:
            if r["field"] in more:
                more[r["field"]].setdefault(r["canonical"], []).append(r["alias"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {f: Matcher(f, e, more[f]) for f, e in lists.items()}
        for b in batches:
            yield b.assign(canon_id=[matchers[f](v) for f, v in zip(b["field"], b["value"])])

    values = long_form(rows, fields, key).where(present("value").isNotNull())
    exact = F.broadcast(canon.select("field", F.col("canonical").alias("value")).distinct())  # no more than MAX_ENTRIES, checked above
    values = values.join(exact, ["field", "value"], "left_anti")
    # Values are grouped before they are judged: a value that most rows carry is judged once.
    distinct = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).select("field", "value")
    judged = distinct.mapInPandas(judge, "field string, value string, canon_id int")
    return values.join(small(cut(judged)), ["field", "value"]).select(key, "field", "value", "canon_id")
