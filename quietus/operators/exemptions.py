"""Exemption records: which are kept, on which condition, and what they seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exemption classes: name, confidence, whether a private member may be retained. Fixed values.
CLASSES = [
    ("interface-satisfaction", "certain", False), ("enum-group", "certain", False), ("generated-file", "certain", True), ("template-field", "possible", False),
    ("reflective-lookup", "possible", False), ("decorator", "certain", True), ("injection-container", "certain", False), ("framework-lifecycle", "certain", False), ("serialization-contract", "certain", False),
]


def classes(spark) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class string, class_confidence string, private_ok boolean")


def retainable(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """Records of a known class on a declaration that the class may retain: private ones only where it says so."""
    dim = F.broadcast(classes(records.sparkSession))  # nine rows
    return records.join(dim, "class").join(symbols.select("id", "visibility"), "id").where("private_ok or visibility <> 'private'").drop("visibility")


def by_member_names(members: DataFrame, names: DataFrame, class_: str, private_ok: bool = False) -> DataFrame:
    """(id, class, detail): members whose name is written elsewhere: in a template, as a literal key, beside ``in``. ``names`` holds name and site."""
    seen = names.groupBy("name").agg(F.min("site").alias("detail"))
    rows = members if private_ok else members.where("visibility <> 'private'")
    return rows.join(seen, "name").select("id", F.lit(class_).alias("class"), "detail")


def of_satisfied_interfaces(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, detail): class members that an interface the class is used as names. ``pairs``: class_id, interface_id."""
    wanted = members.select(F.col("parent").alias("interface_id"), "name", F.col("id").alias("detail"))
    own = members.select(F.col("parent").alias("class_id"), "name", "id")
    return pairs.join(own, "class_id").join(wanted, ["interface_id", "name"]).groupBy("id").agg(F.min("detail").alias("detail")).select("id", F.lit("interface-satisfaction").alias("class"), "detail")


def of_enum_groups(converted: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, detail): members of enums that a value is converted to. ``converted``: enum_id, site."""
    sites = converted.groupBy(F.col("enum_id").alias("parent")).agg(F.min("site").alias("detail"))
    return members.where("kind = 'enum-member'").join(sites, "parent").select("id", F.lit("enum-group").alias("class"), "detail")


def of_marked_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, class, detail): every declaration of a generated file."""
    return symbols.join(files.select("path"), "path", "left_semi").select("id", F.lit("generated-file").alias("class"), F.col("path").alias("detail"))


def of_contracts(contracts: DataFrame, components: DataFrame, members: DataFrame, class_: str) -> DataFrame:
    """(id, class, detail): members that a framework or container calls on the components it knows. ``contracts``: contract, member; ``components``: contract, class_id."""
    known = components.join(contracts, "contract")
    return known.join(members.select(F.col("parent").alias("class_id"), F.col("name").alias("member"), "id"), ["class_id", "member"]).groupBy("id").agg(F.min("contract").alias("detail")).select("id", F.lit(class_).alias("class"), "detail")


def settled(records: DataFrame, called: DataFrame, written: DataFrame, live: DataFrame) -> DataFrame:
    """Records whose conditions hold: every method they implement is called (an empty list holds), the declaration is written where that is asked for, and what they follow is live.

    ``records``: exempt_ord, id, class, while_live, while_written, methods.
    """
    each = records.select("exempt_ord", F.explode_outer("methods").alias("method"))
    called_ = called.select(F.col("id").alias("method"), F.lit(True).alias("c")).distinct()
    ok = each.join(called_, "method", "left").groupBy("exempt_ord").agg(F.bool_and(F.col("method").isNull() | F.coalesce("c", F.lit(False))).alias("implements"))
    rows = records.join(ok, "exempt_ord").join(written.select("id", F.lit(True).alias("w")).distinct(), "id", "left").join(live.select(F.col("id").alias("while_live"), F.lit(True).alias("l")).distinct(), "while_live", "left")
    keep = F.col("implements") & (~F.col("while_written") | F.col("w").isNotNull()) & (F.col("while_live").isNull() | F.col("l").isNotNull())
    return rows.where(keep).select(*records.columns)


def listed(records: DataFrame) -> DataFrame:
    """(id, classes): all classes that retain each declaration, in vocabulary order."""
    order = F.array(*[F.lit(c) for c, _, _ in CLASSES])
    return records.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("class")).alias("k"), "class"))), lambda s: s["class"]), ",").alias("classes"))
