"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Overlapping chunk encoding: a long text is cut into chunks that overlap; each is split into pre-tokens
on its own, in parallel. Where a chunk and its neighbour agree on a pre-token boundary inside their overlap, both
run the same from there on, so the text can be cut at that point. The pieces between the
cuts are encoded independently, and their ids are put together in order. Texts that fit a chunk are one piece.

A cut is taken only behind a character that is no white space, so that a piece ends as it would in the whole text. Where no boundary
is shared (one run of characters longer than the overlap) the text is not cut from there on: exact, only less parallel.

Defined results: null and empty texts give an empty list; special token strings are ordinary text; a repeated ``doc_id`` in
the input gives one row per input row; other columns of the input are ignored. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.cluster import cut

TOKENIZERS = "/opt/tokenizers"
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 2_048
#: A pre-token decision looks at most this far ahead of its end (the contractions: an apostrophe and two letters).
LOOKAHEAD = 4

# Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(name: str, folder: str):
    import tiktoken

    with Path(folder, f"{name}.tiktoken").open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    e = encoding(name, folder)
    return b"".join(e.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def boundaries(text: str, start: int, at_end: bool, head: int, tail: int) -> tuple[list[int], list[int]]:
    """Pre-token starts of a chunk that begins at ``start``, as positions in the whole text: those in
    its first ``head`` characters and those from ``tail`` on, without the ones its cut end may have changed."""
    sure = len(text) if at_end else len(text) - LOOKAHEAD
    first: list[int] = []
    last: list[int] = []
    for m in regex.finditer(PATTERN, text):
        p = m.start()
        if p and m.end() <= sure and not text[p - 1].isspace():
            if p < head:
                first.append(start + p)
            if p >= tail:
                last.append(start + p)
    return first, last


def _cuts(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row_id, at): where each long text may be cut, in characters from 0."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [boundaries(t, s, e, overlap, chunk) for t, s, e in zip(b["part"], b["start"], b["at_end"])]
            yield pd.DataFrame({"row_id": b["row_id"], "start": b["start"], "heads": [x[0] for x in found], "tails": [x[1] for x in found]})

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # In Python a slice takes its own length; Spark's substring counts characters from the start of the text.
        for b in batches:
            for r, t in zip(b["row_id"], b["text"]):
                for s in range(0, len(t), chunk):
                    yield pd.DataFrame({"row_id": [r], "start": [s], "part": [t[s : s + chunk + overlap]], "at_end": [s + chunk + overlap >= len(t)]})

    parts = long.select("row_id", "text").mapInPandas(cut_up, "row_id string, start int, part string, at_end boolean")
    seen = parts.repartition("row_id", "start").mapInPandas(scan, "row_id string, start int, heads array<int>, tails array<int>")
    by = Window.partitionBy("row_id").orderBy("start")
    common = F.array_min(F.array_intersect("heads", F.lag("tails").over(by)))
    met = seen.select("row_id", "start", common.alias("at"))
    broken = F.min(F.when((F.col("start") > 0) & F.col("at").isNull(), F.col("start"))).over(by)
    return met.withColumn("broken", broken).where(F.col("at").isNotNull() & F.col("broken").isNull()).select("row_id", "at")


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    cuts = _cuts(long, chunk, overlap).groupBy("row_id").agg(F.array_sort(F.collect_set("at")).alias("cuts"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, d, t, at in zip(b["row_id"], b["doc_id"], b["text"], b["cuts"]):
                edges = [0, *([] if at is None else at), len(t)]
                for k, (x, y) in enumerate(zip(edges, edges[1:])):
                    yield pd.DataFrame({"row_id": [r], "doc_id": [d], "piece": [k], "text": [t[x:y]]})

    doc = long.schema["doc_id"].dataType.simpleString()
    return long.join(cuts, "row_id", "left").select("row_id", "doc_id", "text", "cuts").mapInPandas(pieces, f"row_id string, doc_id {doc}, piece int, text string")


def encode(
    documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap has to be positive and no longer than a chunk")

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoding(name, folder)
        for t in texts:
            yield pd.Series([e.encode_ordinary(x) if x else [] for x in t], dtype=object)

    docs = documents.select("doc_id", "text")
    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk).select("doc_id", ids("text").alias("ids"))
    # Long texts: their rows get an id of their own, since a doc_id may be null or repeated.
    long = docs.where(F.char_length("text") > chunk).select("doc_id", "text", F.char_length("text").alias("n"), F.expr("uuid()").alias("row_id"))
    long = cut(long)
    if long.isEmpty():
        return short
    done = _pieces(long, chunk, overlap).repartition("row_id", "piece").select("row_id", "doc_id", "piece", ids("text").alias("ids"))
    whole = done.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("all"))
    return short.unionByName(whole.select("doc_id", F.flatten(F.col("all.ids")).alias("ids")))
