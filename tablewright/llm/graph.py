"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.work import Work


def components(links: DataFrame, work: Work, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``links`` (a, b).

    Large-star and small-star rounds (Kiveris et al., 2014): each hangs the
    neighbours of a node on their smallest one until the graph is a set of stars, which one aggregate tells.
    Smallest neighbours are aggregated before the shuffle, so a node with millions of links
    is no single task; every round is a stored table, and only two
    counts come to the driver.  Tables of few links are written by few tasks; ``rows``: the number of ``links``, if known.
    """

    def save(df: DataFrame, label: str) -> DataFrame:
        return work.save(work.dealt(df, rows), f"{name}-{label}")

    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    turn = 0
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = work.dealt(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")), rows)
        number, loose = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)"))).first()
        if not loose:
            break
        rows = 2 * number
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"large-{turn}")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = save(large.distinct(), f"larged-{turn}")
        least2 = save(large.groupBy("a").agg(F.min("b").alias("m")), f"small-{turn}")
        hung = large.join(least2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = save(least2.select("a", F.col("m").alias("b")).unionByName(hung).where("a <> b").distinct(), f"{turn + 1}")
        work.drop(f"{name}-{turn}", f"{name}-large-{turn}", f"{name}-larged-{turn}", f"{name}-small-{turn}")
        edges, turn = small, turn + 1
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def spanning(n: int, a, b):
    """A forest over nodes 0 … n-1 with the components of the links a[i] - b[i], as two arrays of at most n links."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]
