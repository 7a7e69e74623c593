"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _centred(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its neighbours v as ``m``; one row per pair."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return pairs.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link.

    ``links`` has two long columns; direction, repeats and self links don't matter.
    Returns (node, component) with the smallest node of the component, itself included.
    A round replaces each link by one to the smallest known neighbour; rounds grow with
    the logarithm of the longest chain. Each round is written to the shared folder, so a
    lost executor costs one round, and nothing but a count and a sum comes to the driver.
    """
    a, b = links.columns
    edges = links.selectExpr(f"greatest({a}, {b}) AS u", f"least({a}, {b}) AS v").filter("u > v").distinct()
    edges = stored(edges, "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        large = _centred(both).filter("v > u").selectExpr("v AS u", "m AS v").filter("u > v").distinct()
        near = _centred(large)
        small = near.selectExpr("v AS u", "m AS v").union(near.selectExpr("u", "m AS v")).filter("u > v").distinct()
        edges = stored(small, "links")
    # In the end every link leads to its component's smallest node.
    return edges.selectExpr("u AS node", "v AS component").union(edges.selectExpr("v AS node", "v AS component").distinct())
