"""Connected components by contraction: every vertex hooks to its smallest neighbour, and hooked vertices merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def contracted(edges: DataFrame, label: str = "roots") -> DataFrame | None:
    """``edges``: a, b. One row per vertex: x, root (the smallest vertex it is connected with); None without edges.

    At least half of the vertices with edges go in each round, so the rounds are logarithmic. Vertices of a round are
    roots of the one before, so the rounds' answers are put together at the end."""
    rounds = []
    edges = staged(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p")), f"{label}-hooks")
        up = hooks.select(F.col("x").alias("p"), F.col("p").alias("q"))
        jumped = staged(hooks.join(up, "p").select("x", F.col("q").alias("p")), f"{label}-jumped")
        discard(hooks)
        hooks = jumped
        rounds.append(hooks)
        to = lambda c: hooks.select(F.col("x").alias(c), F.col("p").alias(f"{c}2"))
        moved_edges = edges.join(to("a"), "a").join(to("b"), "b").where("a2 != b2")
        moved_edges = staged(moved_edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{label}-edges")
        discard(edges)
        edges = moved_edges
    discard(edges)
    if not rounds:
        return None
    roots = rounds[0].select("x", F.col("p").alias("root"))
    for later in rounds[1:]:
        moved = later.select(F.col("x").alias("root"), "p")
        roots = roots.join(moved, "root", "left").select("x", F.coalesce("p", "root").alias("root"))
    if len(rounds) > 1:
        roots = staged(roots, label)
        discard(*rounds)
    return roots
