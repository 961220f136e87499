"""One union graph over configurations: which configuration's word counts for a declaration, and which references are one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REFERENCE_KEY = ["consumer", "from_id", "to_id", "path", "line", "col", "use"]


def merge_symbols(symbols: DataFrame) -> DataFrame:
    """The first configuration (by config_ord) that judges a declaration gives its fields; reference-only holders judge nothing."""
    judged = symbols.where(~F.col("reference_only"))
    columns = [c for c in judged.columns if c != "id"]
    return judged.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("config_ord", *columns)).alias("s")).select("id", "s.*")


def held_in(symbols: DataFrame) -> DataFrame:
    """(id, configurations): names of all holders, judging or not, in run order."""
    holder = F.array_sort(F.collect_set(F.struct("config_ord", "configuration")))
    return symbols.groupBy("id").agg(F.array_join(F.transform(holder, lambda h: h["configuration"]), ",").alias("configurations"), F.countDistinct("configuration").alias("n_configurations"))


def unjudged(symbols: DataFrame) -> DataFrame:
    """Ids that every holder holds for its references only."""
    return symbols.groupBy("id").agg(F.bool_and("reference_only").alias("only")).where("only").select("id")


def merge_references(references: DataFrame) -> DataFrame:
    """The first configuration's multiset of each key stands, with ``makers``, the configurations that make it, in run order.

    Two references of one key that one configuration makes are two. Grouping by key and configuration first keeps a key that many rows share to a row for each task.
    """
    counted = references.groupBy(*REFERENCE_KEY, "configuration", "config_ord").agg(F.array_sort(F.collect_list("ref_ord")).alias("ords"))
    maker = F.array_sort(F.collect_list(F.struct("config_ord", "configuration")))
    merged = counted.groupBy(*REFERENCE_KEY).agg(F.min_by("ords", "config_ord").alias("ords"), F.array_join(F.transform(maker, lambda m: m["configuration"]), ",").alias("makers"))
    return merged.select(*REFERENCE_KEY, F.explode("ords").alias("ref_ord"), "makers")


def first_facts(exemptions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each fact by ``order``."""
    return exemptions.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
