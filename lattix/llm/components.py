"""Connected components of a table of links, without gathering them anywhere.

Alternating large-star and small-star steps (Kiveris et al. 2014): every step is a
minimum by node (partial aggregation) and a join back, so a hub is split like any
skewed join. Between steps the links are written to the shared folder. Tables of a
checked small size are worked on in one task, which saves their shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SMALL = 200_000  # links, a few MB
Gather = Callable[[DataFrame], DataFrame]


def _large_star(edges: DataFrame, gather: Gather) -> DataFrame:
    both = gather(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, gather: Gather) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return gather(moved.unionAll(least.select("u", F.col("m").alias("v")))).distinct()


def _uneven(edges: DataFrame, gather: Gather) -> DataFrame:
    """Nodes that keep the links from being stars: with two centres, or centres that have one."""
    out = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = gather(out.unionAll(edges.select(F.col("v").alias("node"), F.lit(0), F.lit(1))))
    counted = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return counted.where("out > 1 or (out > 0 and into > 0)")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``links`` (columns u and v); a component is its smallest node.

    Self-links are ignored. The result reads a written table.
    """
    links = links.coalesce(1) if links.count() <= SMALL else links
    edges = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        small = edges.count() <= SMALL

        def gather(df: DataFrame, small=small) -> DataFrame:
            return df.coalesce(1) if small else df

        if not _uneven(gather(edges), gather).limit(1).count():
            break
        after = materialize(_small_star(_large_star(gather(edges), gather), gather), "links")
        discard(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
