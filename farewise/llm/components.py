"""Connected components of an edge table by alternating large and small stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.session import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` that is no ``u`` itself: then ``v`` is the least node of the component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionAll(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``u, v`` edges (longs); the label is the least node of its component.

    Neighbourhoods are never gathered: the least neighbour is an aggregate joined back to the edges. ``edges`` is read
    several times, so pass a written table; edges may repeat, and those from a node to itself are passed over.
    """
    now = edges.select("u", "v").filter("u <> v")
    while True:
        now = materialize(_small(_large(now)), "stars")
        if _all_stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")) \
        .unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def merge_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of the graph that ``labels`` (``node, label``) came from and of more edges between its nodes or others.

    Only the edges between different labels are joined up, not the whole graph again.
    """
    ends = edges.select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(labels.withColumnsRenamed({"node": end, "label": "_label"}), end, "left") \
            .withColumn(end, F.coalesce("_label", end)).drop("_label")
    ends = materialize(ends.filter("u <> v").distinct(), "edges")
    moved = components(ends).select(F.col("node").alias("label"), F.col("label").alias("_least"))
    kept = labels.join(moved, "label", "left").select("node", F.coalesce("_least", "label").alias("label"))
    alone = moved.join(labels.select(F.col("node").alias("label")), "label", "left_anti")
    return kept.unionAll(alone.select(F.col("label").alias("node"), F.col("_least").alias("label")))
