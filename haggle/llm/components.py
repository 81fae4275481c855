"""Connected components of links, as rounds of grouped aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.session import cut_lineage


def _toward_smaller(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step. With `larger`, the larger neighbours of a vertex, else its
    smaller ones and the vertex itself, are tied to the least of its neighbourhood."""
    both = edges.select("u", "v")
    if larger:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least.hint("merge"), "u")  # no broadcast: rounds of them fill a small driver
    if larger:
        return tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()


def _not_yet_stars(edges: DataFrame) -> bool:
    """Whether some vertex is tied to two others, or to one that is itself tied to another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return bool(seen.agg(F.max(F.expr("up > 1 OR up > 0 AND down > 0"))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex on an edge (u, v); a component is its least vertex.

    Each step is two joins on a vertex, with the neighbourhood's minimum taken before
    the shuffle; the rounds are logarithmic in the longest path. They end when each
    vertex but the roots has one link, to a root: links lead to smaller vertices, so
    that root is the least of its component. Self links and repeated or empty links
    do no harm; no edges, no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL")
    every = edges.select(F.col("u").alias("v")).unionByName(edges.select("v")).distinct()
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut_lineage(links.distinct())
    while _not_yet_stars(now):
        now = cut_lineage(_toward_smaller(_toward_smaller(now, True), False))
    return every.join(now.select(F.col("u").alias("v"), F.col("v").alias("component")), "v", "left").select("v", F.coalesce("component", "v").alias("component"))
