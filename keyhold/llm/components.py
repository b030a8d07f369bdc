"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyhold.llm.shared import Scratch, written


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): every linked node with the smallest node it can reach.

    Each round hangs a node's larger neighbours, and then its smaller ones, onto its smallest neighbour, which halves
    paths; the number of rounds grows with the logarithm of the longest one. A node's neighbours are only ever
    aggregated to their minimum and joined, never gathered. Nulls and self links are left out; no links: no rows.
    """
    with Scratch(links.sparkSession) as scratch:
        return _contracted(links, scratch)


def _contracted(links: DataFrame, scratch: Scratch) -> DataFrame:
    edges = written(_down(links.select("a", "b")).distinct(), "links")
    before = _sum(edges)
    while True:
        large = _hang(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), F.col("b") > F.col("a"))
        small = written(_hang(_down(large), F.lit(True)), "stars")
        # done when every node hangs on a root, and no root hangs on anything
        after = _sum(small)
        scratch.drop(edges)
        edges = small
        if after == before:
            break
        before = after
    edges = scratch.keep(edges, "stars")
    roots = edges.groupBy("b").count().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _sum(edges: DataFrame) -> tuple:
    """What tells whether a round has changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _down(links: DataFrame) -> DataFrame:
    """Each link from the larger node (a) to the smaller (b)."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _hang(edges: DataFrame, which) -> DataFrame:
    """Links from the chosen neighbours of each a to the smallest of a and its neighbours; distinct, larger first."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a0"), F.least("a", "m").alias("m"))
    hung = edges.filter(which).join(least, F.col("a") == F.col("a0")).select(F.col("b").alias("x"), "m")
    own = least.select(F.col("a0").alias("x"), "m")
    return hung.union(own).filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
