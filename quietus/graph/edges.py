"""References as edges: what a reference reads, what counts, and for whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reads_of(use: str = "use", namespace: str = "namespace", reexport: str = "reexport") -> Column:
    """whole, passes or none: how an edge enters its target."""
    return F.when(F.col(use).isin("evaluation", "write"), "none").when(~F.col(namespace), "whole").when(F.col(reexport), "passes").otherwise("none")


def graph_edges(references: DataFrame, symbols: DataFrame, targets: bool = True) -> DataFrame:
    """References whose target is a known declaration; ``inside`` tells whether the source is one, too (else the edge is consumed).

    ``targets``: false leaves in those whose target is none, for callers that leave such targets out of what they reach; nothing lies beyond them.
    """
    ids = symbols.select("id").distinct()
    known = references.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi") if targets else references
    sources = ids.select(F.col("id").alias("from_id"), F.lit(True).alias("known"))
    return known.join(sources, "from_id", "left").withColumn("inside", F.col("known").isNotNull() & (F.col("consumer") == "")).withColumn("reads", reads_of()).drop("known")


def reference_counts(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, production, test, consumer_test, guessed_refs) of every declaration that something refers to; guessed references are counted apart."""
    sure = ~F.col("guessed")
    n = lambda when: F.sum(when.cast("long"))
    counted = references.groupBy(F.col("to_id").alias("id")).agg(
        n(sure & ~F.col("test")).alias("production"),
        n(sure & F.col("test")).alias("test"),
        n(sure & F.col("test") & (F.col("consumer") != "")).alias("consumer_test"),
        n(F.col("guessed")).alias("guessed_refs"),
    )
    return counted.join(symbols.select("id").distinct(), "id", "left_semi")  # counts are combined before they are shuffled, references could not be


def counted_refs(production_mode: bool, consumer_tests: bool = False) -> Column:
    """References the mode counts, from the columns of reference_counts."""
    if not production_mode:
        return F.col("production") + F.col("test")
    return F.col("production") + (F.col("consumer_test") if consumer_tests else F.lit(0))


def visibility_reach(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, scope, named): the widest of file, package, outside from which a declaration is referred to, and by how many references."""
    at = symbols.select(F.col("id").alias("to_id"), F.col("path").alias("own_path")).distinct()
    rank = F.when(F.col("consumer") != "", 2).when(F.col("path") != F.col("own_path"), 1).otherwise(0)
    widest = references.join(at, "to_id").groupBy(F.col("to_id").alias("id")).agg(F.max(rank).alias("r"), F.count("*").alias("named"))
    return widest.select("id", F.element_at(F.array(F.lit("file"), F.lit("package"), F.lit("outside")), F.col("r") + 1).alias("scope"), "named")


def write_only(references: DataFrame, exempt: DataFrame) -> DataFrame:
    """(id, writes): declarations with written positions and no read, exempt ones left out."""
    wrote = F.col("use") == "write"
    uses = references.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct(F.when(wrote, F.struct("path", "line"))).alias("writes"), F.count_if(~wrote).alias("reads"))
    return uses.where("writes > 0 and reads = 0").select("id", "writes").join(exempt.select("id"), "id", "left_anti")


def containment(symbols: DataFrame) -> DataFrame:
    """(parent_kind, kind, n, exported): the containment tree, by kinds."""
    holders = symbols.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"))
    return symbols.join(holders, "parent", "left").groupBy(F.coalesce("parent_kind", F.lit("-")).alias("parent_kind"), "kind").agg(F.count("*").alias("n"), F.count_if("exported").alias("exported"))


def whole_reads(symbols: DataFrame) -> DataFrame:
    """(id, child): what a whole read of a file, or of a declared module, also enters: its exported declarations."""
    files = symbols.where("kind = 'file'").select(F.col("id").alias("parent"))
    return symbols.where("exported").join(files, "parent", "left_semi").select(F.col("parent").alias("id"), F.col("id").alias("child"))
