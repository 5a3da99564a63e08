"""Text decoded with the wrong character encoding: finding it, and restoring it where its bytes survive.

Character trigram models, interpolated with bigrams, unigrams and a floor, are counted over the clean values of each field (all rows). Every
value with a character beyond ASCII is scored as it stands and under each candidate chain of encodings (encode with the one it was wrongly
decoded with, decode with the true one, up to three times). The likeliest candidate is accepted if it wins by more than a margin. The margin is
validated on every clean value beyond ASCII, as it stands and garbled by every chain that is tried; a value's own occurrences do not vouch for it there either.

Values count once: candidates are made and scored for distinct values, and joined back to the rows. Grams are counted in hashed tables of a fixed number of buckets: a model has at
most MODEL_ROWS counts however large the corpus is, so it may go to every worker.

Defined results: null, blank and pure ASCII values are never garbled; a value with U+FFFD or a C1 control is always garbled, as no decoding of clean text gives those; it is restored only
if no byte was lost (else ``restored`` is null); equal scores keep the value as it stands, or the earlier chain; very long values are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, scoped, small

FIELDS = ("full_name", "company_name", "company_city")

# Encodings that text is wrongly decoded with, and the ones it was in.
WRONG_FOR_UTF8 = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859_2", "koi8_r", "cp866")
WRONG_FOR_WESTERN = ("cp1251", "cp850", "mac_roman", "cp437", "koi8_r")
WRONG_FOR_CYRILLIC = ("cp1252",)
DEPTH = 3

WEIGHTS = (0.70, 0.22, 0.07)
FLOOR = 1e-6
#: Bits of the hashed tables of trigrams, bigrams and characters, and the counts that a model of one field has at most (grams and their contexts).
BITS = (22, 18, 14)
MODEL_ROWS = (1 << BITS[0]) + 2 * (1 << BITS[1]) + 2 * (1 << BITS[2]) + 1
#: Chains that garble a value, by whether the way back ends in UTF-8.
CHAINS = {True: len(WRONG_FOR_UTF8) + 1, False: len(WRONG_FOR_WESTERN) + len(WRONG_FOR_CYRILLIC)}
#: What an error on a clean value weighs in the validation against the share of its chains that is missed, as few values are garbled.
CLEAN_WEIGHT = 30.0
MARGINS = tuple(x / 10 for x in range(10, 121))
SLACK = 4.0
#: Log odds that a word mixing Latin and Cyrillic letters gives to a candidate without one.
MIXED_SCRIPT = 3.0
#: And what a candidate loses that makes such a word.
MADE_MIXED = 20.0


@lru_cache(maxsize=None)
def table(name: str) -> dict[str, int]:
    """Character -> byte of a one-byte encoding; bytes it leaves out stand for the control of the same number."""
    to = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        to.setdefault(c, b)
    for b in range(0x80, 0xA0):  # controls pass through, as lenient decoders do
        to.setdefault(chr(b), b)
    return to


_C1 = re.compile("[\x80-\x9f]")


def back(text: str, wrong: str, true: str) -> tuple[str, bool] | None:
    """``text`` encoded with ``wrong`` and decoded with ``true``, and whether nothing was lost. None where that is no candidate."""
    try:
        raw = text.encode(wrong)
    except UnicodeEncodeError:
        if not _C1.search(text):
            return None
        to = table(wrong)
        try:
            raw = bytes(to[c] for c in text)
        except KeyError:
            return None
    if true != "utf8":
        try:
            return raw.decode(true), True
        except UnicodeDecodeError:
            return None
    out = raw.decode("utf8", errors="replace")
    good = sum(c > "\x7f" and c != "�" for c in out)
    return (out, "�" not in out) if good and good >= out.count("�") else None


def candidates(text: str) -> list[tuple[str, str, bool]]:
    """(chain, text, nothing lost) of every candidate but the value itself."""
    found: dict[str, tuple[str, bool]] = {}
    todo = [(text, "", True)]
    for depth in range(DEPTH):
        after = []
        for t, chain, whole in todo:
            if t.isascii() or "�" in t:
                continue
            steps = [(w, "utf8") for w in WRONG_FOR_UTF8] + ([(w, "cp1252") for w in WRONG_FOR_WESTERN] + [(w, "cp1251") for w in WRONG_FOR_CYRILLIC] if depth == 0 else [])
            for wrong, true in steps:
                r = back(t, wrong, true)
                if r and r[0] != t and r[0] not in found and r[0] != text:
                    chain2 = f"{chain}>{wrong}:{true}" if chain else f"{wrong}:{true}"
                    found[r[0]] = (chain2, whole and r[1])
                    if true == "utf8":
                        after.append((r[0], chain2, whole and r[1]))
        todo = after
    return [(c, t, w) for t, (c, w) in found.items()]


@lru_cache(maxsize=None)
def _wrongly(name: str) -> dict[int, str]:
    """Byte -> character of a lenient decoder."""
    return {b: c for c, b in reversed(table(name).items())}


def _decoded(raw: bytes, wrong: str) -> str:
    try:
        return raw.decode(wrong)
    except UnicodeDecodeError:
        return "".join(_wrongly(wrong).get(b, chr(b)) for b in raw)


def garbled_by(text: str) -> list[tuple[str, bool]]:
    """``text`` as each chain that is tried garbles it, once, and twice by the commonest; and whether the way back ends in UTF-8."""
    out = []
    for wrong in WRONG_FOR_UTF8:
        t = _decoded(text.encode(), wrong)
        out.append((t, True))
        if wrong == "cp1252":
            out.append((_decoded(t.encode(), wrong), True))
    for true, wrongs in (("cp1252", WRONG_FOR_WESTERN), ("cp1251", WRONG_FOR_CYRILLIC)):
        try:
            raw = text.encode(true)
        except UnicodeError:
            continue
        out += [(_decoded(raw, w), False) for w in wrongs]
    return [(t, u) for t, u in out if t != text]


def long_form(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "seq") -> DataFrame:
    """(key, field, value) of every value present."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return rows.select(key, F.explode_outer(cells).alias("c")).select(key, "c.field", "c.value").where(F.col("value").isNotNull())


_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
#: The parts of a model, in one array: trigrams, their contexts, bigrams, their contexts, characters, all characters.
_SIZES = (1 << BITS[0], 1 << BITS[1], 1 << BITS[1], 1 << BITS[2], 1 << BITS[2], 1)
_AT = np.concatenate([[0], np.cumsum(_SIZES)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(6, positions) of where in a model each character's grams and contexts are counted, and the first position of each text. Without case; two marks stand before a text, one after."""
    padded = [f"\x02\x02{t.lower()}\x03" for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in padded])
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), dtype=bool)
    inside[ends - lengths] = inside[ends - lengths + 1] = False
    at = np.flatnonzero(inside)
    a, b, c = points[at - 2], points[at - 1], points[at]
    with np.errstate(over="ignore"):
        h = lambda bits, *xs: sum((x * m for x, m in zip(xs, _MIX)), np.uint32(0)) >> np.uint32(32 - bits)
        found = [h(BITS[0], a, b, c), h(BITS[1], a, b), h(BITS[1], b, c), h(BITS[2], b), h(BITS[2], c), np.zeros(len(c), dtype=np.uint32)]
    starts = np.concatenate([[0], np.cumsum(lengths - 2)[:-1]])
    return np.stack([f.astype(np.int64) + o for f, o in zip(found, _AT[:-1])]), starts


def likelihood(model: np.ndarray, texts: list[str], own: list[float], anchor: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text without the ``own`` occurrences of the value it is made from (``texts[anchor]``), and with them: what the value
    says of itself counts neither for it nor for the candidates that share most of it."""
    where, starts = grams(texts)
    n = model[where]
    ends = [*starts[1:].tolist(), where.shape[1]]
    mine = np.zeros(where.shape)
    # A value comes before the texts made from it: what it marks is what they share with it.
    mark = np.full(_AT[-1], -1, dtype=np.int32)
    i = 0
    while i < len(texts):
        j = i + 1
        while j < len(texts) and anchor[j] == i:
            j += 1
        if own[i]:
            a, z = starts[i], ends[j - 1]
            mark[where[:, a : ends[i]]] = i
            mine[:, a:z] = (mark[where[:, a:z]] == i) * own[i]
        i = j

    p = np.full(where.shape[1], FLOOR)
    q = p.copy()
    for w, k in zip(WEIGHTS, (0, 2, 4)):
        count, context = n[k], n[k + 1]
        q += w * count / np.maximum(context, 1)
        left = np.maximum(count - mine[k], 0)
        p += w * left / np.maximum.reduce([context - mine[k + 1], left, np.ones_like(left)])
    return np.add.reduceat(np.log(p), starts), np.add.reduceat(np.log(q), starts)


_MARKED = re.compile("[\x80-\x9f\ufffd]")
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z\u00c0-\u024f]")
_TRIED = "field string, value string, n long, clean boolean, chains array<string>, texts array<string>, wholes array<boolean>"


def _try(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each value, and whether it is clean to begin with: no character that only wrong decoding makes, and no chain that ends in well-formed UTF-8."""
    for b in batches:
        found = [candidates(v) for v in b.column("value").to_pylist()]
        clean = [not _MARKED.search(v) and not any(w and c.endswith(":utf8") for c, _, w in f) for v, f in zip(b.column("value").to_pylist(), found)]
        more = [pa.array(clean, pa.bool_()), *(pa.array([[x[k] for x in f] for f in found], t) for k, t in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.bool_()))))]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("field", "value", "n")] + more, names=["field", "value", "n", "clean", "chains", "texts", "wholes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's clean values add to the models, bucket by bucket."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        fields, values, n = (b.column(c).to_pylist() for c in ("field", "value", "n"))
        for f in set(fields):
            mine = [i for i, x in enumerate(fields) if x == f]
            where, starts = grams([values[i] for i in mine])
            weight = np.repeat([n[i] for i in mine], np.diff([*starts, where.shape[1]])).astype(float)
            model = sums.setdefault(f, np.zeros(_AT[-1]))
            for w in where:
                model += np.bincount(w, weights=weight, minlength=_AT[-1])
    for f, model in sums.items():
        at = np.flatnonzero(model)
        yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(model[at], pa.float64())], names=["field", "bucket", "n"])


def models(clean: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """field -> buckets and counts of its model, of (field, value, n). No more than MODEL_ROWS rows a field come to the driver, whatever the corpus."""
    rows = clean.select("field", "value", "n").mapInArrow(_count, "field string, bucket long, n double").groupBy("field", "bucket").agg(F.sum("n").alias("n")).toArrow()
    fields, buckets, n = rows["field"].to_numpy(zero_copy_only=False), rows["bucket"].to_numpy(), rows["n"].to_numpy()
    return {f: (buckets[fields == f].astype(np.int32), n[fields == f].astype(np.float32)) for f in set(fields)}


def whole(shared, field: str, ready: dict[str, np.ndarray]) -> np.ndarray:
    """The model of a field with all its buckets, made once a task."""
    if field not in ready:
        ready[field] = np.zeros(_AT[-1], dtype=np.float32)
        if field in shared.value:
            at, n = shared.value[field]
            ready[field][at] = n
    return ready[field]


def _script(value: str, text: str) -> float:
    """What it tells that a candidate takes Latin and Cyrillic letters apart, or throws them together."""
    a, b = bool(_MIXED.search(value)), bool(_MIXED.search(text))
    return MIXED_SCRIPT if a and not b else -MADE_MIXED if b and not a else 0.0


def _judged(model: np.ndarray, value: str, n: float, clean: bool, chains, texts, wholes, score: list[tuple[float, float]]):
    """(chain, text, whole, margin) of the best candidate; ``score`` of the value and then of each candidate."""
    if not chains:
        return None, None, None, -1e9
    stands, as_counted = score[0]
    ranked = [(s + _script(value, t), -len(c), c, t, w) for (s, _), c, t, w in zip(score[1:], chains, texts, wholes)]
    best, _, chain, text, whole = max(ranked)
    # A one-byte chain always gives some text: it must also stand up to the value with all its occurrences, else a value that is often written so would fall.
    if not chain.endswith(":utf8") and best < as_counted - SLACK:
        return chain, text, whole, -1e8
    return chain, text, whole, best - stands


def _scorer(shared):
    """Scores values: a row a value, or with ``validate`` the weights of the errors that each margin makes on the clean values."""

    def scored(batch: pa.RecordBatch, ready: dict[str, np.ndarray]):
        data = batch.to_pydict()
        for f in set(data["field"]):
            model = whole(shared, f, ready)
            mine = [i for i, x in enumerate(data["field"]) if x == f]
            texts, own, anchor, ends = [], [], [], [0]
            for i in mine:
                anchor += [len(texts)] * (1 + len(data["texts"][i]))
                texts += [data["value"][i], *data["texts"][i]]
                own += [data["n"][i] if data["clean"][i] else 0] * (1 + len(data["texts"][i]))
                ends.append(len(texts))
            p, q = likelihood(model, texts, own, anchor)
            for k, i in enumerate(mine):
                part = list(zip(p[ends[k] : ends[k + 1]], q[ends[k] : ends[k + 1]]))
                yield f, model, i, data, part, _judged(model, data["value"][i], data["n"][i], data["clean"][i], data["chains"][i], data["texts"][i], data["wholes"][i], part)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, np.ndarray] = {}
        for b in batches:
            out = [(f, d["value"][i], *best) for f, _, i, d, _, best in scored(b, ready)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["field", "value", "chain", "text", "whole", "margin"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(MARGINS)
        wrong = {True: np.zeros(len(at)), False: np.zeros(len(at))}
        ready: dict[str, np.ndarray] = {}
        for b in batches:
            todo: dict[str, tuple[np.ndarray, list]] = {}
            for f, model, i, d, _, (chain, _, _, margin) in scored(b, ready):
                wrong[chain is None or chain.endswith(":utf8")] += CLEAN_WEIGHT * (margin > at)
                more = todo.setdefault(f, (model, []))[1]
                first = len(more)
                more.append((d["value"][i], d["n"][i], first, None, 0.0))
                more.extend((t, d["n"][i], first, u, _script(t, d["value"][i])) for t, u in garbled_by(d["value"][i]))
            for model, more in todo.values():
                texts, own, anchor, utf8, bonus = (list(x) for x in zip(*more))
                p, _ = likelihood(model, texts, own, anchor)
                margins = p[anchor] + np.array(bonus) - p
                for u in (True, False):
                    wrong[u] += (margins[[x is u for x in utf8]][:, None] <= at).sum(0) / CHAINS[u]
        out = [(u, float(a), float(e)) for u, w in wrong.items() for a, e in zip(at, w)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.bool_(), pa.float64(), pa.float64()))], names=["utf8", "at", "errors"])

    return rows, errors


@scoped
def find(values: DataFrame) -> DataFrame:
    """Of distinct (field, value, n): the garbled ones, as (field, value, restored, chain, margin)."""
    spark = values.sparkSession
    values = cut(values.select("field", "value", "n"))
    odd = F.col("value").rlike("[^\\x00-\\x7F]")
    tried = values.where(odd)
    if tried.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        tried = tried.repartition(2 * spark.sparkContext.defaultParallelism)  # the candidates are the work
    tried = cut(tried.mapInArrow(_try, _TRIED))
    shared = spark.sparkContext.broadcast(models(values.where(~odd).unionByName(tried.where("clean").select("field", "value", "n"))))
    rows, errors = _scorer(shared)
    # The margin that errs least on the validation values, for chains that end in UTF-8 and for the others.
    told = tried.where("clean").mapInArrow(errors, "utf8 boolean, at double, errors double").groupBy("utf8", "at").agg(F.sum("errors").alias("errors"))
    chosen = told.groupBy("utf8").agg(F.min(F.struct("errors", "at")).alias("best")).collect()  # two rows at most
    margins = {r["utf8"]: r["best"]["at"] for r in chosen}
    usual = MARGINS[len(MARGINS) // 2]
    utf8 = F.coalesce(F.col("chain").endswith(":utf8"), F.lit(True))
    top = tried.mapInArrow(rows, "field string, value string, chain string, text string, whole boolean, margin double")
    ok = F.col("margin") > F.when(utf8, F.lit(margins.get(True, usual))).otherwise(F.lit(margins.get(False, usual)))
    found = top.where(ok | F.col("value").rlike("[\\x80-\\x9F\\uFFFD]"))
    return found.select("field", "value", F.when(ok & F.col("whole"), F.col("text")).alias("restored"), F.when(ok, F.col("chain")).alias("chain"), "margin")


def garbled(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "seq") -> DataFrame:
    """(key, field, value, restored, chain, margin) of every garbled value."""
    cells = long_form(rows, fields, key)
    found = find(cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))
    # Only what can be garbled is looked up.
    may = cells.where(F.col("value").rlike("[^\\x00-\\x7F]"))
    return may.join(small(found), ["field", "value"])
