"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs, any order, repeats and loops allowed. Returns (id, comp), comp being the smallest id that
    can be reached; one row for each id that has an edge to another. No edges: no rows.

    Minima are pre-aggregated before each shuffle, and joins on a hot node can be split by AQE. Each round is a table
    in the shared folder, so a lost executor costs one round at most. Rounds grow with the logarithm of the size; they end
    when a round's edges are those of the round before.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    e = save(edges.where("a <> b").select(big, small).distinct(), "edges")
    n = e.count()
    while n:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        step = e.join(m, "v").select("u", F.col("m").alias("v")).distinct()
        m = step.groupBy("u").agg(F.min("v").alias("m"))
        step = step.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()
        before, last, e = e, n, save(step, "stars")
        n = e.count()
        if n == last and e.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, comp) of components, joined where links (a, b) connect them; ids without a row are their own."""
    if label is None:
        return components(links)
    over = links
    for c in ("a", "b"):
        known = label.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        over = over.join(known, c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    over = save(over.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "over")
    top = components(over)
    roots = over.select(F.col("a").alias("id"), F.col("a").alias("comp")).union(over.select("b", "b"))
    every = label.union(roots).distinct().join(top.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    return save(every.select("id", F.coalesce("top", "comp").alias("comp")), "labels")
