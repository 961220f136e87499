"""Weakly connected components by alternating star contractions.

Each round is two grouped minima and two equi-joins, so no task sees more than the edges of one vertex, and the joins'
large side stays a plain exchange that adaptive execution may split when one vertex holds very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.session import cut, kept


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def weak_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, root)`` for every vertex of ``edges``; root is the smallest vertex of its component.

    Null ends and self loops name a vertex but join nothing; repeated edges count once. Raises if ``max_rounds`` is too few.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    ends = kept(ends.distinct(), "ends", codec="zstd")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    stars = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before = _mark(stars)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        stars = kept(_small_star(kept(_large_star(stars), "large", codec="zstd")), "stars", codec="zstd")
        after = _mark(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle within max_rounds")
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, label)`` for every vertex of ``edges``: a vertex within two steps, the smallest after two rounds of minima.

    Vertices of one label are of one component; a component may have several labels. That is enough to leave out what is known to hang together, at two grouped minima.
    """
    ends = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct())
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label"))
    second = both.join(first.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("label"))
    return cut(second.withColumnRenamed("u", "node"))
