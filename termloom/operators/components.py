"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialise


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an edge list; root is the smallest node of its component.

    Direction, repeats and self-loops do not matter; edges with a null end are left out; no edges give no
    rows. Each round is two star contractions, written to scratch in place of the round before; it ends when a
    round changes nothing. The result is a scratch table, which discard() deletes.
    Every step is a join or a pre-aggregated minimum, so a node with very many neighbours is no task of its own.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    first = last = materialise(e, "edges")
    nodes = first.select("u").union(first.select("v")).distinct()
    before = None
    e = first.where("u <> v")
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(least.select("u", "m")).distinct(), "edges")
        if last is not first:
            discard(last)
        last = e
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == before:
            break
        before = now
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = nodes.select(F.col("u").alias("node")).join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    out = materialise(out, "components")
    discard(first, last)
    return out
