"""Groups of records that pairwise agreements link, directly or through others.

Rows that hold a key are stood for by the smallest of their ids (the key's representative), so a key that
a third of all rows hold costs one row of an aggregate and no pairs. Keys of one row link nothing and go first. Only rows with two or more different
representatives make edges, between representatives. In that graph the component of the highest-degree vertex is peeled by breadth-first frontier joins
and anti-joined away. The rest is labelled by minimum propagation with pointer jumping and contraction: each round every vertex joins its
smallest neighbour's tree and the edges are rewritten to tree roots, so the rounds grow with the logarithm of the longest path, not with the path.

A component whose breadth exceeds ``rounds`` is peeled so far. What was reached is connected, so it may be contracted into one vertex, its
smallest, without any component changing: the rest of it follows in the propagation, with the same labels for every ``rounds``.

Defined results: null ids are left out, repeated ids are one record, null keys link nothing, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, scoped, small
from leadloom.llm.keys import external, mailbox, personal, profile
from leadloom.operators.graph import links, propagate, rewrite

FRONTIER_ROUNDS = 6


def peel(edges: DataFrame, rounds: int = FRONTIER_ROUNDS) -> tuple[DataFrame | None, DataFrame]:
    """Labels (v, label) of what is reached from the vertex of highest degree, and the edges that remain."""
    both = links(edges)
    top = both.groupBy("a").count().select(F.struct("count", "a").alias("k")).agg(F.max("k").alias("k")).select(F.col("k.a").alias("v"))  # one row
    seen = front = cut(top.where(F.col("v").isNotNull()))
    if seen.isEmpty():
        return None, edges
    over = False
    for _ in range(rounds):
        near = both.join(small(front), both["a"] == front["v"]).select(F.col("b").alias("v")).distinct()
        front = cut(near.join(seen, "v", "left_anti"))
        if front.isEmpty():
            over = True
            break
        seen = cut(seen.unionByName(front))
    least = seen.agg(F.min("v").alias("label"))
    labels = cut(seen.crossJoin(F.broadcast(least)))  # one row
    if over:
        rest = edges.join(seen, edges["a"] == seen["v"], "left_anti")
    else:
        rest = rewrite(edges, labels)
    return labels, cut(rest)


@scoped
def label_graph(edges: DataFrame, rounds: int = FRONTIER_ROUNDS) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b), label the smallest vertex of the component. Vertices are of any ordered type."""
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    peeled, rest = peel(edges, rounds)
    others = propagate(rest)
    if peeled is None:
        return others
    # What was contracted may have met a smaller label, and then carries it.
    met = others.select(F.col("v").alias("label"), F.col("label").alias("now"))
    peeled = peeled.join(met, "label", "left").select("v", F.coalesce("now", "label").alias("label"))
    return peeled.unionByName(others.join(peeled.select("v"), "v", "left_anti"))


def stars(keyed: DataFrame) -> DataFrame:
    """(a, b): from the smallest id that holds a key to each other one, of (id, key). Keys are compared whole."""
    held = keyed.where(F.col("id").isNotNull() & F.col("key").isNotNull())
    hubs = held.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where(F.col("a") != F.col("last")).select("key", "a")
    return held.join(hubs, "key").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))


@scoped
def linked(keyed: DataFrame, rounds: int = FRONTIER_ROUNDS) -> DataFrame:
    """(id, label) of every id of ``keyed`` (id, key) that shares a key with another."""
    pairs = cut(stars(keyed).distinct())
    # Every representative of a row is linked to the row's least one, however many there are.
    first = cut(pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("v")))
    edges = pairs.join(first, pairs["b"] == first["id"]).where(F.col("a") != F.col("v")).select(F.col("v").alias("a"), F.col("a").alias("b"))
    # A representative may itself be a row of another key's.
    hubs = pairs.select(F.col("a").alias("id")).distinct()
    up = hubs.join(first, "id").select(F.col("v").alias("a"), F.col("id").alias("b"))
    labels = label_graph(edges.unionByName(up), rounds)
    every = first.unionByName(hubs.join(first, "id", "left_anti").select("id", F.col("id").alias("v")))
    return every.join(labels, "v", "left").select("id", F.coalesce("label", "v").alias("label"))


def group(keyed: DataFrame, rounds: int = FRONTIER_ROUNDS) -> DataFrame:
    """(id, label) of every id of ``keyed`` (id, key); rows with a null id or key link nothing."""
    ids = keyed.where(F.col("id").isNotNull() & F.col("key").isNotNull()).select("id").distinct()
    return ids.join(linked(keyed, rounds), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def lead_keys(leads: DataFrame) -> DataFrame:
    """(id, key) of what makes two leads agree: id at the provider, personal mailbox, personal profile."""
    key = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(kind), c))
    cells = leads.select(F.col("seq").alias("id"), external("external_id", "provider").alias("x"), mailbox("email").alias("m"), profile("linkedin_url").alias("p"))
    keys = cells.select("id", F.array(key("x:", F.col("x")), key("m:", personal(F.col("m"))), key("p:", F.col("p"))).alias("keys"))
    # An inner explode would have the optimizer filter by the array's size first, with every expression in it computed once more.
    return keys.select("id", F.explode_outer("keys").alias("key")).where(F.col("key").isNotNull())


@scoped
def lead_groups(leads: DataFrame) -> DataFrame:
    """(group_seq, seq): of each group of two or more leads its smallest seq, and every other one."""
    found = linked(cut(lead_keys(leads)))
    return found.where(F.col("id") != F.col("label")).select(F.col("label").alias("group_seq"), F.col("id").alias("seq"))
