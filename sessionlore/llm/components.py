"""Connected components of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id that
    can be reached. Alternates small-star and large-star rounds until nothing
    changes; each round is written to the shared folder. A node with very
    many links is met by partial minima and a join that Spark may split."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, path = stored(edges, "links")
    before = None
    while (now := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = now
        # Small star: the smaller neighbours of a node point to the least.
        edges, path = _star(edges, edges, path)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: the larger neighbours of a node point to its least.
        edges, path = _star(both, both, path, larger=True)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _star(neighbours: DataFrame, source: DataFrame, path: str, larger: bool = False) -> tuple[DataFrame, str]:
    spark = neighbours.sparkSession
    least, least_path = stored(source.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    met = neighbours.join(least, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    edges, new_path = stored(out.where("a > b").distinct(), "links")
    dropped(spark, path, least_path)
    return edges, new_path
