"""Personal information inside free text, found by a character network and replaced by typed placeholders.

A bidirectional LSTM over characters with CRF transitions, trained in numpy (``pii_train``) from labelled spans. A text of any length is cut into
overlapping windows; the scores of a character come from the window it stands furthest inside of, and one Viterbi pass over the
whole text reconciles the windows. The ends of the spans that come out are then set to the boundaries of their words and numbers.

Defined results: null, empty and blank texts have no mentions and come out as they are; positions count code points from 1; mentions never overlap; a
repeated ``doc_id`` gives the mentions of each of its rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW = 1_024
OVERLAP = 48
#: Characters in one pass of the network, which bounds a worker's memory, and in the texts that are worked on together.
PASS = 1 << 18
TOGETHER = 1 << 20

BASES = 96
CLASSES = 9
_SCRIPTS = (("CJK", 70), ("HIRAGANA", 71), ("KATAKANA", 72), ("CYRILLIC", 73), ("ARABIC", 74), ("HANGUL", 75), ("DEVANAGARI", 76), ("GREEK", 77), ("LATIN", 78))


def _ids(c: str) -> tuple[int, int]:
    """What a character is (its base letter or script), and of which class."""
    category = unicodedata.category(c)
    upper, letter = c.isupper(), category[0] in "LM"
    base = unicodedata.normalize("NFKD", c.lower())[:1] or c
    special = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "s", "æ": "a", "œ": "o", "ı": "i", "þ": "t"}.get(base)
    accented = base != c.lower() or special is not None
    base = special or base
    if c in "\n\r":
        return 2, 3
    if base.isspace():
        return 1, 3
    if "a" <= base <= "z":
        return 3 + ord(base) - 97, (5 if upper else 4) if accented else (1 if upper else 0)
    if base.isdigit() and base.isascii():
        return 29 + int(base), 2
    if base.isascii() and base.isprintable():
        return 39 + ("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".find(base) % 31), 6
    if base in "’‘":
        return 39 + 6, 6
    name = unicodedata.name(base, "")
    for word, i in _SCRIPTS:
        if word in name:
            return i, (8 if upper else 7) if letter else 6
    return (79 if letter else 80 if category[0] in "PS" else 81), (8 if upper else 7) if letter else 6


#: What each code point met so far is, as one number (base * CLASSES + class); -1 is not met yet.
_met = np.full(0x110000, -1, dtype=np.int16)


def encode(text: str) -> np.ndarray:
    """(2, length) of base and class ids; 0 is padding."""
    one = symbols(text)
    return np.stack([one // CLASSES, one % CLASSES])


def symbols(text: str) -> np.ndarray:
    """Base and class id of each character as one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = _met[points]
    if one.size and one.min() < 0:
        for p in np.unique(points[one < 0]):
            base, cls = _ids(chr(p))
            _met[p] = base * CLASSES + cls
        one = _met[points]
    return one


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """The trained network. The input's part of the gates is a table by symbol, so a step is one product with the state.

    The logistic gates are (tanh(x / 2) + 1) / 2. The halves are in the weights: the state is kept doubled, and the products with it are by halved weights.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        w = {k: np.asarray(v, dtype=np.float32) for k, v in w.items()}
        half, size = w["base"].shape[1], w["h_f"].shape[0]
        gates = np.full(4 * size, 0.5, dtype=np.float32)
        gates[3 * size :] = 1
        self.size, self.tables, self.state = size, [], []
        for d in ("f", "b"):
            by_base = w["base"] @ w[f"x_{d}"][:half] + w[f"bias_{d}"]
            by_class = w["cls"] @ w[f"x_{d}"][half:]
            self.tables.append(np.ascontiguousarray(((by_base[:, None] + by_class[None]) * gates).reshape(-1, 4 * size), dtype=np.float32))
            self.state.append(np.ascontiguousarray(w[f"h_{d}"] * gates * 0.5, dtype=np.float32))
        self.out, self.out_bias, self.moves, self.start = w["out"] * np.float32(0.5), w["out_bias"], w["moves"], w["start"]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(steps, windows, tags) of symbols (steps, windows)."""
        steps, n = ids.shape
        s = self.size
        scores = np.broadcast_to(self.out_bias, (steps, n, TAGS)).copy()
        states = np.empty((steps, n, s), dtype=np.float32)
        z, y = np.empty((n, 4 * s), dtype=np.float32), np.empty((n, 4 * s), dtype=np.float32)
        new, top = np.empty((n, s), dtype=np.float32), np.empty((n, s), dtype=np.float32)
        for d, (table, wh) in enumerate(zip(self.tables, self.state)):
            h, c = np.zeros((n, s), dtype=np.float32), np.zeros((n, s), dtype=np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(table, ids[t], axis=0, out=z, mode="clip")
                np.matmul(h, wh, out=y)
                z += y
                np.tanh(z, out=z)
                z[:, : 3 * s] += 1
                c *= z[:, s : 2 * s]
                np.multiply(z[:, :s], z[:, 3 * s :], out=new)
                c += new
                c *= 0.5
                np.tanh(c, out=top)
                h = states[t]
                np.multiply(z[:, 2 * s : 3 * s], top, out=h)
            scores += states @ self.out[d * s : (d + 1) * s]
        return scores

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each text, all texts step by step together, longest first."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        lengths = np.array([len(scores[i]) for i in order])
        if not len(lengths) or not lengths[0]:
            return [np.zeros(0, dtype=np.int8) for _ in scores]
        # Step by step, what the texts that still go on have there, one behind the other.
        at = np.concatenate([np.arange(n) for n in lengths])
        by_step = np.concatenate([scores[i] for i in order])[np.argsort(at, kind="stable")]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        offsets = np.concatenate([[0], np.cumsum(alive)])
        moves = np.ascontiguousarray(self.moves.T)
        best = self.start + by_step[: alive[0]]
        backs = np.zeros(by_step.shape, dtype=np.int8)
        ended: list[np.ndarray] = []
        flat = np.arange(len(order) * TAGS) * TAGS
        for t in range(1, lengths[0]):
            n = alive[t]
            if n < len(best):
                ended.append(best[n:])
                best = best[:n]
            every = best[:, None, :] + moves
            back = every.argmax(axis=2)
            best = every.reshape(-1)[flat[: n * TAGS] + back.reshape(-1)].reshape(n, TAGS)
            best += by_step[offsets[t] : offsets[t + 1]]
            backs[offsets[t] : offsets[t + 1]] = back
        final = np.concatenate([best, *reversed(ended)]).argmax(axis=1).astype(np.int8)
        tags = np.zeros(len(by_step), dtype=np.int8)
        now = np.zeros(0, dtype=np.int8)
        for t in range(lengths[0] - 1, -1, -1):
            n = alive[t]
            if n > len(now):  # texts that end here
                now = np.concatenate([now, final[len(now) : n]])
            tags[offsets[t] : offsets[t + 1]] = now
            now = backs[offsets[t] : offsets[t + 1]][np.arange(n), now]
        out: list[np.ndarray] = [None] * len(scores)
        own = np.empty_like(tags)
        own[np.argsort(at, kind="stable")] = tags
        for i, a, n in zip(order, np.concatenate([[0], np.cumsum(lengths)]), lengths):
            out[i] = own[a : a + n]
        return out

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The tag of every character of every text."""
        ids = [symbols(t) for t in texts]
        stride = WINDOW - 2 * OVERLAP
        windows = []
        for k, x in enumerate(ids):
            for a in range(0, max(1, len(x) - 2 * OVERLAP), stride):
                windows.append((k, a, min(len(x), a + WINDOW)))
        windows.sort(key=lambda w: w[2] - w[1])
        scores = [np.empty((len(x), TAGS), dtype=np.float32) for x in ids]
        p = 0
        while p < len(windows):
            # Windows of about one length, so that little is padding.
            q = p + 1
            while q < len(windows) and (q + 1 - p) * (windows[q][2] - windows[q][1]) <= PASS and windows[q][2] - windows[q][1] <= 1.1 * (windows[p][2] - windows[p][1]) + 16:
                q += 1
            part = windows[p:q]
            p = q
            grid = np.zeros((len(part), part[-1][2] - part[-1][1]), dtype=np.int16)
            for j, (k, a, b) in enumerate(part):
                grid[j, : b - a] = ids[k][a:b]
            e = self.emissions(np.ascontiguousarray(grid.T))
            for j, (k, a, b) in enumerate(part):
                # A character of two windows is taken from the one it stands further inside of.
                lo = a if a == 0 else a + OVERLAP
                hi = b if b == len(ids[k]) else b - OVERLAP
                scores[k][lo:hi] = e[lo - a : hi - a, j]
        return self.viterbi(scores)


@lru_cache(maxsize=2)
def network(path: str) -> Network:
    with np.load(path) as w:
        return Network(dict(w))


_LEFT = {
    "email": re.compile(r"(?:[A-Za-z0-9_+'-]+(?: dot | ?[\[(]dot[\])] ?))*[A-Za-z0-9_.+'-]+\Z"), "phone": re.compile(r"[\d+(/.-]+\Z"), "id_number": re.compile(r"[A-Za-z0-9-]+\Z"),
    "address": re.compile(r"[\w.]+\Z"), "name": re.compile(r"[a-zA-ZÀ-ɏḀ-ỿЀ-ӿ]+\Z"),
}
_FIRST = {
    "email": re.compile(r"[A-Za-z0-9_]"), "phone": re.compile(r"[\d+(]|[a-z]", re.I), "id_number": re.compile(r"[A-Za-z0-9]"),
    "address": re.compile(r"\w"), "name": re.compile(r"[^\W\d_]"),
}
# Titles that stand before a name and are no part of it.
_TITLES = re.compile(r"(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|monsieur|madame|señora?|sra?|el|la)\b\.?\s+", re.I)
_LINE = re.compile(r"[^\r\n]+")
_TOKEN = re.compile(r"\S*")
_JAPANESE_NAME = re.compile(r"[一-鿿々ヶ]{1,4}[ 　]?[一-鿿々]{1,3}(?=さん|様|氏)")
_INNER = re.compile(r"(?:[A-Z]\.|van|von|der|den|de) ")
_BEFORE = re.compile(r"(?:^|[\s(\"'])([A-ZÀ-ÝĀ-Ž][^\W\d_]+ (?:van |von |de )?)\Z")
_SPACED = re.compile(r"[a-zA-ZÀ-ɏḀ-ỿЀ-ӿ0-9]")


def _leftward(pattern: re.Pattern, text: str, a: int) -> re.Match | None:
    """What of the pattern ends at ``a``, however far left it begins."""
    n = 64
    while True:
        lo = max(0, a - n)
        m = pattern.search(text, lo, a)
        if lo == 0 or (m and m.start() > lo) or (m is None and text.count(" ", lo, a) > 3):
            return m
        n *= 8


def _lines(text: str, a: int, b: int, kind: str) -> list[tuple[int, int, str]]:
    """A span over a line break is one mention a line: a stub of a word before the break is none, and a line with an at sign is a mailbox."""
    out = []
    for m in _LINE.finditer(text, a, b):
        x, y = m.start(), m.end()
        if y < b and x == a and x > 0 and text[x - 1].isalnum():
            continue  # begins inside a word and ends with its line
        out.append((x, y, "email" if kind == "name" and "@" in _TOKEN.match(text, x)[0] else kind))
    return out


def mentions(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) from the tags, the ends set to the words they stand in."""
    spans: list[tuple[int, int, str]] = []
    n = len(text)
    marked = np.flatnonzero(tags)
    # A mention goes on as long as the next character continues its kind.
    goes_on = np.zeros(len(marked), dtype=bool)
    kinds = (tags[marked] - 1) // 2
    goes_on[1:] = (np.diff(marked) == 1) & (tags[marked[1:]] % 2 == 0) & (kinds[1:] == kinds[:-1])
    starts = np.flatnonzero(~goes_on)
    for i, j in zip(starts, [*starts[1:], len(marked)]):
        spans += _lines(text, int(marked[i]), int(marked[j - 1]) + 1, KINDS[kinds[i]])
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if kind == "name" and (m := _JAPANESE_NAME.search(text, max(0, a - 2), min(n, b + 4))) and m.start() < b:
            a, b = m.start(), m.end()
        elif _FIRST[kind].match(text, a) and (m := _leftward(_LEFT[kind], text, a)):
            a -= m.end() - m.start()
        while a < b and not _FIRST[kind].match(text, a):
            a += 1
        if kind == "name" and (m := _TITLES.match(text, a, b)) and m.end() < b:
            a = m.end()
        # An initial or particle is not where a name starts if a capitalised word stands before it.
        if kind == "name" and _INNER.match(text, a) and (m := _leftward(_BEFORE, text, a)):
            a -= len(m[1])
        while 0 < b < n and b > a and kind in ("email", "name", "id_number") and _SPACED.match(text[b]) and _SPACED.match(text[b - 1]):
            b += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a and (not out or a >= out[-1][1]):
            out.append((a, b, kind))
    return out


def find(documents: DataFrame, weights: str | Path = WEIGHTS) -> DataFrame:
    """(doc_id, text, spans) of every document, spans an array of (start_pos, end_pos, kind)."""
    path = str(weights)

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int,kind:string>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = network(path)
        for t in texts:
            out: list = [[] for _ in range(len(t))]
            todo = [(i, x) for i, x in enumerate(t) if x and not x.isspace()]
            while todo:
                # Texts of about one pass of windows at a time, whatever their lengths.
                k = size = 0
                while k < len(todo) and (k == 0 or size < TOGETHER):
                    size += len(todo[k][1])
                    k += 1
                for (i, x), tags in zip(todo[:k], net.tag([x for _, x in todo[:k]])):
                    out[i] = [{"start_pos": a + 1, "end_pos": b, "kind": kind} for a, b, kind in mentions(x, tags)]
                todo = todo[k:]
            yield pd.Series(out)

    # The network is the work: documents go round to all cores, however few files they are in.
    docs = documents.select("doc_id", "text")
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < 2 * cores:
        docs = docs.repartition(4 * cores)
    return docs.select("doc_id", "text", spans("text").alias("spans"))


def listed(documents: DataFrame, weights: str | Path = WEIGHTS) -> DataFrame:
    """(doc_id, kind, start_pos) of every mention."""
    # An inner explode would have the optimizer filter by the number of spans first, and so run the network twice.
    return find(documents, weights).select("doc_id", F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull()).select("doc_id", "s.kind", "s.start_pos")


def masked(documents: DataFrame, weights: str | Path = WEIGHTS) -> DataFrame:
    """(doc_id, text) with every mention replaced by its kind in brackets, the rest as it is."""

    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t is None or len(s) == 0:
                out.append(t)
                continue
            parts, at = [], 0
            for x in s:
                parts += [t[at : x["start_pos"] - 1], f"[{x['kind'].upper()}]"]
                at = x["end_pos"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(cover, "string")
    return find(documents, weights).select("doc_id", udf("text", "spans").alias("text"))
