"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.session import discard, materialize



def components(links: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``links`` (a, b); the root is the component's least vertex.

    In each round a vertex hooks to its least neighbour if that is less than itself, chains are
    shortened by pointer jumps (four hooks become one), and links are rewritten to the vertices
    hooked to; links within one vertex vanish. Vertices that are left more than halve in practice
    (a star ends in one round). Every step is a join or a grouped minimum with map-side combine;
    joins read written tables, so the engine can split a hub's rows. Nothing reaches the driver
    but how many links are left, by which the next round's files are dealt.
    """
    links = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels, left = None, links.count()
    vertices = 2 * left
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        hooks = materialize(hooks, "hooks", 2 * left)
        jumped = hooks
        for _ in range(3):
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = jumped.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        jumped = materialize(jumped, "hooks", 2 * left)
        discard(hooks)
        if labels is None:
            labels = materialize(jumped.select(F.col("a").alias("node"), F.col("p").alias("root")), "labels", vertices)
        else:
            up = jumped.select(F.col("a").alias("root"), "p")
            fresh = materialize(labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels", vertices)
            discard(labels)
            labels = fresh
        rest = links.join(jumped.select("a", F.col("p").alias("pa")), "a").select("pa", "b")
        rest = rest.join(jumped.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").where("pa != pb")
        rest = materialize(rest.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "links", left)
        discard(links, jumped)
        links, left = rest, rest.count()
        if not left:
            discard(links)
            return labels
