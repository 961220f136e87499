"""One code for each subject: ordered rules over candidates, over live exports, and over the parts of a function.

A rule is a column expression over one row; what a row must know of others (its container's death, its tests, its roots) comes to it by joins before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of members, of containers whose type parameters are reported, and kinds with a rule of their own. Fixed values.
MEMBERS = ["method", "class-member", "type-member", "enum-member"]
SIGNATURES = ["function", "method", "type"]
OWN_RULE = ["file", "interface", "interface-method", "type-parameter"]
TYPE_KINDS = ["class", "interface", "type", "enum"]

#: Root kind, whether it publishes what it names, whether it only runs a file. Fixed values.
ROOT_KINDS = [
    ("entry-file", False, False), ("manifest-entry", True, False), ("manifest-binary", False, True), ("script", False, True), ("type-query-alias", False, False), ("published-api", True, False),
    ("entry-reach", False, False), ("test-reach", False, False), ("configured", False, False), ("pattern", False, False), ("type-error", False, False), ("global-augmentation", False, False),
    ("configuration-file", False, False), ("configuration-string", False, True), ("bundler-entry", False, False), ("test-runner", False, False), ("convention", False, False), ("html-entry", False, True),
    ("html-import", False, False), ("document-import", False, False), ("workflow-step", False, True),
]

#: What a candidate may know beside id, kind, exported, production, test and relation; each is false, or empty, where a table does not say.
FLAGS = ["container_dead", "in_test", "test_of_dead", "unreferenced_test", "held_by_itself", "kept_by_tests", "deprecated", "brand", "marker", "encapsulated", "rooted"]


def with_flags(candidates: DataFrame) -> DataFrame:
    """``candidates`` with every flag and a parent_kind."""
    rows = candidates.withColumns({f: F.coalesce(F.col(f), F.lit(False)) if f in candidates.columns else F.lit(False) for f in FLAGS})
    return rows if "parent_kind" in rows.columns else rows.withColumn("parent_kind", F.lit("file"))


def code_of_dead(fallen: bool = False) -> Column:
    """The code of a candidate; with ``fallen``, what one whose container is dead would have if that were live. Null: it is not reported.

    Columns: kind, exported, parent_kind, production, test, relation, and FLAGS.
    """
    kind, production, test = F.col("kind"), F.col("production"), F.col("test")
    named = production + test > 0
    unused_by_rule = kind.isin(OWN_RULE) | ((kind == "enum-member") & ~named)
    own = F.col("container_dead") if fallen else ~F.col("container_dead")
    only_test_code = F.col("in_test") & ~F.col("unreferenced_test")
    alone = ~named & ~F.col("container_dead")
    by_rule = (
        F.when((kind == "interface") & ~only_test_code, "DS1201")
        .when((kind == "interface-method") & ~only_test_code & alone & ~F.col("marker"), "DS1202")
        .when((kind == "type-parameter") & alone & F.col("parent_kind").isin(SIGNATURES), "DS1006")
        .when((kind == "enum-member") & alone, "DS1005")
    )
    tests = (test > 0) & ((production == 0) | F.col("kept_by_tests"))
    old = (production == 0) & F.col("deprecated")
    unreachable = F.col("encapsulated") & F.col("exported") & (F.col("parent_kind") == "file") & ~F.col("rooted")
    by_shape = F.when(kind.isin(MEMBERS), "DS1003").when(~F.col("exported"), "DS1002").when(unreachable & ~tests & ~old, "DS1101").otherwise("DS1001")
    only_tests = (test > 0) & ((production == 0) | ((F.col("relation") == "reachability") & F.col("kept_by_tests")))
    by_use = F.when(F.col("unreferenced_test"), by_shape).when(F.col("held_by_itself"), "DS1102").when(old, "DS1104").when(only_tests, "DS1102").otherwise(by_shape)
    code = F.when(own & F.col("test_of_dead"), "DS1103").when(unused_by_rule, F.lit(None) if fallen else by_rule).when(own & ~only_test_code, by_use)
    return F.when((code == "DS1003") & F.col("brand"), None).otherwise(code)


def root_flags(roots: DataFrame) -> DataFrame:
    """``roots`` (id, kind) with publishes, run_only and enters (whether a tool may read what it exports by name)."""
    kinds = F.broadcast(roots.sparkSession.createDataFrame(ROOT_KINDS, "kind string, publishes boolean, run_only boolean"))  # 21 rows
    return roots.join(kinds, "kind").withColumn("enters", ~F.col("publishes") & ~F.col("run_only") & ~F.col("kind").isin("entry-reach", "test-reach"))


def runner_calls() -> Column:
    """Whether a test runner calls an export: a function, or anything below ``__mocks__``. Columns: kind, path."""
    return (F.col("kind") == "function") | F.array_contains(F.split("path", "/"), "__mocks__")


def entered(symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, published, by_name, file_published, file_by_name): how the roots of each declaration and of its file enter it. ``symbols``: id, kind, path, parent."""
    flagged = root_flags(roots)
    own = flagged.groupBy("id").agg(F.bool_or("publishes").alias("published"), F.bool_or("enters").alias("by_name"))
    wide = F.col("enters") & (F.col("kind") != "document-import")
    files = flagged.groupBy(F.col("id").alias("file")).agg(F.bool_or(wide & (F.col("kind") != "test-runner")).alias("file_wide"), F.bool_or(wide).alias("file_called"))
    reached = symbols.join(own.where("published").select("id"), "id", "left_semi").select("path").distinct().withColumn("file_published", F.lit(True))
    holders = symbols.where("kind = 'file'").select("path", F.col("id").alias("file"))
    rows = symbols.select("id", "kind", "path").join(own, "id", "left").join(holders, "path", "left").join(files, "file", "left").join(reached, "path", "left")
    no = F.lit(False)
    by_file = F.coalesce("file_wide", no) | (F.coalesce("file_called", no) & runner_calls())
    return rows.select("id", F.coalesce("published", no).alias("published"), F.coalesce("by_name", no).alias("by_name"), F.coalesce("file_published", no).alias("file_published"), by_file.alias("file_by_name"))


def code_of_live(closed: bool) -> Column:
    """The narrowing code of a live declaration, or null. Columns: kind, exported, parent_kind, written, named, scope, exposed, and those of ``entered``."""
    judged = F.col("exported") & (F.col("parent_kind") == "file") & ~F.col("written") & (F.col("kind") != "export-alias") & ~F.col("by_name") & ~F.col("file_by_name") & (F.col("named") > 0)
    keyword = (F.col("scope") == "file") & (F.lit(closed) | ~F.col("file_published"))
    export = F.lit(closed) & (F.col("scope") == "package") & F.col("published") & ~F.col("exposed")
    return F.when(judged & keyword, "DS1503").when(judged & export, "DS1501")


def part_findings(parts: DataFrame, signatures: DataFrame, rooted: DataFrame, callers_unknown: DataFrame, discarded: DataFrame) -> DataFrame:
    """(declaration, kind, name, code, fix, confidence): parts of functions that are reported.

    ``parts``: declaration, kind, name, in_value, counted, annotated, before_a_read, contextual. ``signatures``: declaration, state, which is free, valued (free but for uses as a value) or fixed.
    A parameter goes where its signature is free; of a function used as a value it is renamed where a read parameter follows, else deleted. A result goes where the signature is free and all known calls, all there are, discard it.
    """
    flag = lambda table, name: table.select(F.col(table.columns[0]).alias("declaration"), F.lit(True).alias(name)).distinct()
    rows = parts.join(signatures, "declaration", "left")
    for table, name in ((rooted, "rooted"), (callers_unknown, "callers_unknown"), (discarded, "discarded")):
        rows = rows.join(flag(table, name), "declaration", "left").na.fill(False, [name])
    state = F.coalesce("state", F.lit("fixed"))
    free = ~F.col("in_value") & (state == "free")
    valued = ~free & (F.col("in_value") | (state == "valued"))
    sure = lambda doubt: F.when(doubt, "probable").otherwise("certain")
    parameter = (
        F.when(free & F.col("annotated").isNull(), F.struct(F.lit("delete").alias("fix"), sure(F.col("counted") & F.col("rooted")).alias("confidence")))
        .when(free, None)
        .when(valued & F.col("before_a_read"), F.struct(F.lit("rename").alias("fix"), F.lit("certain").alias("confidence")))
        .when(valued & (F.coalesce("annotated", F.lit("")) != "steers"), F.struct(F.lit("delete").alias("fix"), sure((F.coalesce("annotated", F.lit("")) == "free") | F.col("contextual") | F.col("counted")).alias("confidence")))
    )
    result = F.when((state == "free") & F.col("discarded") & ~F.col("callers_unknown"), F.struct(F.lit("delete").alias("fix"), F.lit("certain").alias("confidence")))
    other = F.struct(F.lit("delete").alias("fix"), F.lit("certain").alias("confidence"))
    codes = {"parameter": "DS1401", "result": "DS1403", "dead-store": "DS1404", "unreachable-statement": "DS1405", "unreachable-case": "DS1406"}
    code = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), codes.items(), F.when(F.lit(False), ""))
    said = F.when(F.col("kind") == "parameter", parameter).when(F.col("kind") == "result", result).otherwise(other)
    return rows.select("declaration", "kind", "name", code.alias("code"), said.alias("said")).where("said is not null and code is not null").select("declaration", "kind", "name", "code", "said.fix", "said.confidence")


def discarded_everywhere(calls: DataFrame) -> DataFrame:
    """(declaration): functions with calls, all of which, in every configuration, discard the result. ``calls``: declaration, use."""
    return calls.groupBy("declaration").agg(F.bool_and(F.col("use") == "discarded").alias("all")).where("all").select("declaration")


def outside_skipped(rows: DataFrame, skipped: DataFrame, block: int = 64) -> DataFrame:
    """``rows`` (path, line, ...) without those inside a range (path, from_line, to_line) that a type error hides; rows and ranges meet on (path, block of lines)."""
    spans = skipped.select("path", "from_line", "to_line", F.explode(F.sequence(F.floor(F.col("from_line") / block), F.floor(F.col("to_line") / block))).alias("b"))
    keyed = rows.withColumn("b", F.floor(F.col("line") / block))
    inside = (keyed["path"] == spans["path"]) & (keyed["b"] == spans["b"]) & (F.col("line") >= F.col("from_line")) & (F.col("line") <= F.col("to_line"))
    return keyed.join(spans, inside, "left_anti").drop("b")


def repeated_cases(cases: DataFrame) -> DataFrame:
    """(switch, position, key): cases whose key an earlier case of their switch has. ``cases``: switch, position, key; a null key (a default, or computed) repeats nothing."""
    first = cases.where("key is not null").groupBy("switch", "key").agg(F.min("position").alias("first"))
    return cases.join(first, ["switch", "key"]).where("position > first").select("switch", "position", "key")
