"""Labelled spans to train the tagger of personal information with.

Rules over bounded samples: notations of mailboxes, telephone and identity numbers, street addresses, and names put together from a list of given
names (taken from a lead table) and the shape of surnames. They only make training labels; texts are searched by the network of ``pii``.
"""

from __future__ import annotations

import re

from leadloom.llm.people import AROUND, NICKNAMES, fold

KINDS = ("email", "phone", "id_number", "address", "name")

_DOT = r"(?:\.| dot | ?[\[(]dot[\])] ?)"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9_+'-]*(?:{_DOT}[A-Za-z0-9_+'-]+)*(?:@| @ | ?[\[(]at[\])] ?| at )[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}(?:example|test|invalid|com|org|net)(?![A-Za-z])", re.I)
_SAID = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double"
PHONE = re.compile(
    rf"(?<![\w/.+-])(?:\+\d[\d .()/-]{{7,20}}\d|00\d{{9,13}}|00\d{{1,3}} \d[\d ]{{6,12}}\d|0\d{{3}} \d{{3}} \d{{3,4}}|0\d{{3}} \d{{6,7}}|\(\d{{3}}\) \d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}"
    rf"|\d{{1,3}}/\d{{3}}/\d{{6,7}}|\d{{3}}-\d{{3}}-\d{{5,6}}|\d{{3}} \d{{3}} \d{{3}} \d{{3}}|(?:{_SAID})(?:[ -](?:{_SAID})){{6,}})(?![\w/-]|\.\d)",
    re.I,
)
IDENTITY = re.compile(
    r"(?<![\w/.#-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{3,5}\d{6,7}[A-Z]?\d?[A-Z]{1,2}|[A-Z0]\d{8,9}[A-Z]?|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}"
    r"|\d{2} \d{6} [A-Z] \d{3}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z])(?![\w/-])"
)
CITIZEN = re.compile(r"(?:CCCD|マイナンバー|個人番号)\D{0,30}?(\d[\d -]{10,13}\d)")
_ROAD = "Lane|Road|Rd|Street|St|Avenue|Ave|Way|Close|Court|Ct|Crescent|Cres|Parade|Terrace|Blvd|Boulevard|Drive|Dr|Place|Square|Gardens|Row|Hill|Walk|Mews"
ADDRESS = re.compile(
    rf"(?<![\w#])(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Z]?, )?\d{{1,4}}[A-D]? [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:{_ROAD})\b"
    r"|(?<!\w)(?:P\.? ?O\.? ?|Post Office )Box \d+|(?<!\w)(?:Postfach|Apartado(?: de [Cc]orreos)?|BP) \d+"
    r"|(?<![\w-])\d{1,4}(?: bis| ter)?, (?:rue|chemin|allée|avenue|place|impasse|boulevard|quai|route|passage) "
    r"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Carretera|C/) [^\n,]{3,40}, \d+"
    r"|(?<!\w)(?:(?:Obere|Untere|Alte|Neue|Am|Im|An der|Zum|Zur|Kleine|Große|Lange|Hintere|Vordere)[rnsm]? )?[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|gasse|ring|allee|pfad|ufer|damm|hof|steig|stieg|graben) \d+ ?[a-z]?(?=,)"
    r"|(?<!\w)[Ss]ố \d+[A-Z]?,? (?:đường|phố|ngõ) ",
)
_LINK = re.compile(r"https?://\S+|@\w+_\w+")
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*\.?")
JAPANESE = re.compile(r"[一-鿿々ヶ]{1,4}[ 　]?[一-鿿々]{1,3}(?=さん|様|氏)")
_SHAPE = re.compile(r"^(?:mac|mc|o)?(?:(?:bl|br|dr|fr|gl|gr|kr|st|tr|[bdfghjklmnprstvwyz])[aeiouy]){2,}[a-z]*$")
# Words behind the first word of a company's name.
COMPANY = frozenset(
    fold(x)
    for x in "packaging optics international partners atelier estudio foods robotics energy logistics instruments textiles señalización materials biotech consulting analytics technologies design studio construção manufacturing frères systems società meblowa spółka câbles möbel énergie media daughters söhne fils âme ãtria bakery staffing group gmbh corp inc ltd limited".split()
)
MONTHS = frozenset("january february march april may june july august september october november december".split())
_BEFORE_MONTH = frozenset("in on after until before every by since to from of end le el am ngay between till for and or during late early mid livree entregado giao".split())
FAMILY_VI = frozenset("Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý".split())
MIDDLE_VI = frozenset("Thị Văn Minh Ngọc Quang".split())


def given_names(first_names, least: int = 8) -> frozenset[str]:
    """Folded given names that occur ``least`` times, and nicknames."""
    seen: dict[str, int] = {}
    for n in first_names:
        w = fold((n or "").strip())
        if len(w) > 1 and w.isalpha():
            seen[w] = seen.get(w, 0) + 1
    return frozenset(w for w, n in seen.items() if n >= least) | frozenset(NICKNAMES)


NEVER = frozenset(("Đơn", "Delivery"))
PARTICLES = frozenset("van von der den de di da dos la le ten ter bin al".split())
#: Folded words that are names only in their own spelling, or in front of a surname.
ORDINARY = frozenset("my son lan an will may bill rich dick sue pat drew don max sam".split())


def common_words(texts, share: float = 0.002, least: int = 8) -> frozenset[str]:
    """Folded words of many texts, which are no surnames."""
    seen: dict[str, int] = {}
    n = 0
    for t in texts:
        n += 1
        for w in {fold(m[0].rstrip(".")) for m in _WORD.finditer(t)}:
            seen[w] = seen.get(w, 0) + 1
    return frozenset(w for w, k in seen.items() if k >= max(least, share * n))


def _surname(w: str, common: frozenset[str]) -> bool:
    f = fold(w).replace("’", "").replace("'", "")
    return len(f) >= 6 and f not in common and bool(_SHAPE.match(f))


def names(text: str, given: frozenset[str], common: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    taken = [(m.start(), m.end()) for m in _LINK.finditer(text)] + [(m.start(), m.end()) for m in EMAIL.finditer(text)]

    def kind(i: int) -> str:
        """g given, s surname, i initial, f family and m middle name (Vietnamese), or nothing."""
        a, b, w = words[i]
        if any(x <= a < y for x, y in taken) or (a and (text[a - 1].isdigit() or text[a - 1] in "#_/<" and text[a - 2 : a] != "/ ")):
            return ""
        bare = w.rstrip(".")
        if len(bare) == 1 and bare.isupper() and w.endswith("."):
            return "i"
        if bare in NEVER:
            return ""
        if bare.title() in FAMILY_VI:
            return "f"
        if bare.title() in MIDDLE_VI:
            return "m"
        if bare in PARTICLES:
            return "p"
        nxt = fold(words[i + 1][2].rstrip(".")) if i + 1 < len(words) and words[i + 1][0] - b <= 3 else ""
        if fold(bare) in given and (fold(bare) not in ORDINARY or not bare.isascii() or (i + 1 < len(words) and words[i + 1][0] - b == 1 and words[i + 1][2][:1].isupper() and _surname(words[i + 1][2].rstrip("."), common))):
            return "g"
        if _surname(bare, common) and nxt not in COMPANY and text[b : b + 2] not in ("’s", " &") and text[b : b + 3] not in (" Nº", " No", " – ", " an"):
            return "s"
        return ""

    kinds = [kind(i) for i in range(len(words))]
    gap = lambda i: text[words[i][1] : words[i + 1][0]] if i + 1 < len(words) else "\n"
    out = []
    i = 0
    while i < len(words):
        k, (a, b, w) = kinds[i], words[i]
        bare = w.rstrip(".")
        case = "u" if bare.isupper() else "c" if bare[:1].isupper() else "l"
        j = i
        if k in ("g", "i", "s", "f") and (case != "l" or k == "g" or (k == "f" and i + 1 < len(words) and kinds[i + 1] == "m" and gap(i) == " ")):
            if k == "f" or (k == "g" and i + 1 < len(words) and kinds[i + 1] == "f" and gap(i) == " "):
                while j + 1 < len(words) and kinds[j + 1] in ("m", "g", "f", "i", "s") and gap(j) in (" ", "-") and j - i < 4:
                    j += 1
                if j > i:
                    out.append((a, words[j][1]))
                    i = j + 1
                    continue
            j = i
            if k in ("g", "i"):
                while j + 1 < len(words) and kinds[j + 1] == "i" and gap(j) == " ":
                    j += 1
                t = j
                while t + 1 < len(words) and kinds[t + 1] == "p" and gap(t) == " " and t - j < 2:
                    t += 1
                if t > j and t + 1 < len(words) and kinds[t + 1] == "s" and gap(t) == " ":
                    j = t
                if j + 1 < len(words) and kinds[j + 1] == "s" and gap(j) in (" ", "  ") and (words[j + 1][2][:1].isupper() or case == "l"):
                    j += 1
                    if j + 1 < len(words) and gap(j) == "-" and kinds[j + 1] in ("s", "g"):
                        j += 1
                    out.append((a, words[j][1]))
                    i = j + 1
                    continue
                if k == "g" and case != "l":
                    before = fold(words[i - 1][2].rstrip(".")) if i and a - words[i - 1][1] <= 2 else ""
                    month = fold(bare) in MONTHS and (before in _BEFORE_MONTH or re.match(r"\s*\d", text[b:]) or text[a - 1 : a] in ("(", ) or re.search(r"stamp: [^\n.]*, $", text[max(0, a - 40) : a]) or re.search(r"\d\s*$|[はが]$", text[max(0, a - 2) : a]))
                    if not month:
                        out.append((a, b if not w.endswith(".") else b - 1))
                i += 1
                continue
            if k == "s":
                if gap(i) == "-" and i + 1 < len(words) and kinds[i + 1] == "s":
                    j = i + 1
                if j + 1 < len(words) and kinds[j + 1] in ("g", "i") and (gap(j) == ", " or (gap(j) == " " and case == "u")):
                    j += 1
                out.append((a, words[j][1] if not words[j][2].endswith(".") or kinds[j] == "i" else words[j][1] - 1))
                i = j + 1
                continue
        i += 1
    out += [(m.start(), m.end()) for m in JAPANESE.finditer(text)]
    return out


def spans(text: str, given: frozenset[str], common: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind), not overlapping."""
    found: list[tuple[int, int, str]] = []
    links = [(m.start(), m.end()) for m in _LINK.finditer(text)]

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in found) and all(b <= x or a >= y for x, y in links):
            found.append((a, b, kind))

    for m in EMAIL.finditer(text):
        add(m.start(), m.end(), "email")
    for m in CITIZEN.finditer(text):
        add(m.start(1), m.end(1), "id_number")
    for m in ADDRESS.finditer(text):
        # The rest of the address: its parts up to a place, a code, or the end of the sentence.
        tail = re.match(r"[^\n.;|/]{0,60}?(?:, (?:\d{4,6} )?[A-ZÀ-Ý][\w’-]+(?: [A-ZÀ-Ý][\w’-]+){0,3}(?: \d{4,6})?)(?=[,.;\n\s]|$)", text[m.end() :])
        add(m.start(), m.end() + (tail.end() if tail else 0), "address")
    for m in PHONE.finditer(text):
        if not re.search(r"(?:PO|batch|SKU|reference|scheme|Lieferung|Commande|Pedido|Đơn|注文|Fi1e|File|page) ?$", text[max(0, m.start() - 12) : m.start()]):
            add(m.start(), m.end(), "phone")
    for m in IDENTITY.finditer(text):
        if not re.search(r"(?:PO|batch|SKU|reference|scheme|Lieferung|Commande|Pedido|Đơn|注文|Fi1e|File|page|ticket|Ticket|Invoice|Rechnung|facture?a?|Hóa đơn|請求書|pass) ?$", text[max(0, m.start() - 12) : m.start()]):
            add(m.start(), m.end(), "id_number")
    for a, b in names(text, given, common):
        while a < b and fold(text[a:b].split(" ")[0]).strip(".") in AROUND and " " in text[a:b]:
            a += text[a:b].index(" ") + 1
        add(a, b, "name")
    return sorted(found)

