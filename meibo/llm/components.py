"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meibo.operators.lookup import lookup_join
from meibo.operators.staging import stage


def _ranked(node: str) -> Column:
    """A node in the order of a hash, in which no order of the nodes themselves shows."""
    return F.struct(F.xxhash64(node).alias("rank"), F.col(node).alias("node"))


def _contracted(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges between the new names of their ends, each once, without loops."""
    for end in ("a", "b"):
        named = names.select(F.col("node").alias(end), F.col("name").alias(f"new_{end}"))
        edges = lookup_join(edges, [end], named, "inner", staged=end == "a")
    low, high = F.least("new_a", "new_b"), F.greatest("new_a", "new_b")
    return edges.where("new_a <> new_b").select(low.alias("a"), high.alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges (a, b); the component is the smallest node of it.

    Every round points each node to the first of its neighbours, or itself, in a hashed order, follows
    that pointer's own pointer, and replaces the ends of the edges by what they point to. Nodes with
    one name become one node, edges inside it go, so the graph shrinks by a constant factor in each
    round, whatever its shape. No key needs all edges of a hub, or all nodes of a component, in
    one task: neighbours are reduced map-side, and names are looked up by joins that split hot
    keys. Each round is written; only the question whether edges are left reaches the driver.

    Repeated edges, loops and both directions of an edge are allowed; edges with a null end are left out.
    """
    good = edges.where("a is not null and b is not null")
    whole = good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stage(whole, "edges")
    names = None
    while names is None or not left.isEmpty():
        ends = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointed = ends.groupBy("a").agg(F.min(_ranked("b")).alias("near"))
        pointed = stage(pointed.select(F.col("a").alias("node"), F.least(_ranked("a"), F.col("near"))["node"].alias("name")), "pointers")
        onward = pointed.select(F.col("node").alias("name"), F.col("name").alias("far"))
        step = stage(lookup_join(pointed, ["name"], onward, "inner", staged=True).select("node", F.col("far").alias("name")), "pointers")
        if names is None:
            names = step
        else:
            onward = step.select(F.col("node").alias("name"), F.col("name").alias("far"))
            known = lookup_join(names, ["name"], onward, "left", staged=True)
            names = stage(known.select("node", F.coalesce("far", "name").alias("name")), "names")
        left = stage(_contracted(left, step), "edges")
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return lookup_join(names, ["name"], least, "inner", staged=True).select("node", "component")
