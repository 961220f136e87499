"""What stands behind references and exemptions: who made a reference, what a whole read enters, which types are exposed, and which configured entries name what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.graph.walk import reach
from quietus.operators.codes import MEMBERS, TYPE_KINDS
from quietus.operators.selfcheck import subject_of


def made_by_tests(references: DataFrame, support: DataFrame) -> DataFrame:
    """``references`` with by_test: a test file made it, or a test-support file of the target (not of a consumer)."""
    files = support.select("path", F.lit(True).alias("is_support")).distinct()
    return references.join(files, "path", "left").withColumn("by_test", F.col("test") | ((F.col("consumer") == "") & F.col("is_support").isNotNull())).drop("is_support")


def withheld_by(production: bool, consumer_tests_count: bool) -> Column:
    """Whether a mode counts no reference like this one: production leaves out what tests made, but for a consumer's where its tests count as production. Columns: by_test, consumer."""
    return F.lit(production) & F.col("by_test") & ~((F.col("consumer") != "") & F.lit(consumer_tests_count))


def stores(references: DataFrame, support: DataFrame, production: bool, consumer_tests_count: bool = False) -> tuple[DataFrame, DataFrame]:
    """(references that the mode counts, the declarations (id) that tests read)."""
    rows = made_by_tests(references, support)
    return rows.where(~withheld_by(production, consumer_tests_count)), rows.where("by_test and use <> 'write'").select(F.col("to_id").alias("id")).distinct()


def unheld(references: DataFrame, held_files: DataFrame) -> DataFrame:
    """``references`` with unheld: made in a test file that no project holds, so that it is an edge from outside."""
    held = held_files.select("path", F.lit(True).alias("held")).distinct()
    return references.join(held, "path", "left").withColumn("unheld", F.col("test") & F.col("held").isNull()).drop("held")


def whole_reads_of_groups(symbols: DataFrame) -> DataFrame:
    """(id, child): what a whole read of each container enters. A file, or a declared module, gives its exported declarations.

    Declarations that share parent and reference are one merged value: where one of them is a namespace with a value, a read of any enters the exported members of the namespaces, the static members of the class and the enum's members.
    ``symbols``: id, kind, parent, ref, exported, is_static, block (module for a declared module, value for a namespace with a value).
    """
    holder = symbols.select(F.col("id").alias("parent"), F.col("kind").alias("h_kind"), F.col("block").alias("h_block"), F.col("parent").alias("h_parent"), F.col("ref").alias("h_ref"))
    rows = symbols.select("id", "kind", "exported", "is_static", "parent").join(holder, "parent")
    module = (F.col("h_kind") == "file") | (F.coalesce("h_block", F.lit("")) == "module")
    direct = rows.where(module & F.col("exported")).select(F.col("parent").alias("id"), F.col("id").alias("child"))
    value = F.coalesce("block", F.lit("")) == "value"
    group = symbols.where(F.col("kind").isin("class", "enum", "function") | value).select("id", "parent", "ref", value.alias("value"))
    spaces = group.where("value").select(F.col("parent").alias("h_parent"), F.col("ref").alias("h_ref")).distinct()
    member = ((F.coalesce("h_block", F.lit("")) == "value") & F.col("exported")) | ((F.col("h_kind") == "class") & F.col("is_static")) | ((F.col("h_kind") == "enum") & (F.col("kind") == "enum-member"))
    merged = rows.where(~module & member).select("h_parent", "h_ref", F.col("id").alias("child")).join(spaces, ["h_parent", "h_ref"])
    every = merged.join(group.select("id", F.col("parent").alias("h_parent"), F.col("ref").alias("h_ref")), ["h_parent", "h_ref"]).select("id", "child")
    return direct.unionByName(every).distinct()


def exposed_types(symbols: DataFrame, carriers: DataFrame, outside: DataFrame, unread: DataFrame) -> tuple[DataFrame, bool]:
    """(types (id) that code outside holds values of, whether all are): what references from outside name passes the reach on to what it carries, a type to its exported members, a namespace to what it exports, a member to its type.

    A declaration reached whose surface was left unread exposes every type. ``symbols``: id, kind, parent, exported. ``carriers``: id, carried_id.
    """
    holder = symbols.select(F.col("id").alias("parent"), F.col("kind").alias("h_kind"))
    rows = symbols.select("id", "kind", "exported", "parent").join(holder, "parent")
    member = F.col("kind").isin(MEMBERS)
    down = rows.where((F.col("h_kind").isin(TYPE_KINDS) & member & F.col("exported")) | ((F.col("h_kind") == "namespace") & F.col("exported"))).select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"))
    up = rows.where(member).select(F.col("id").alias("from_id"), F.col("parent").alias("to_id"))
    edges = carriers.select(F.col("id").alias("from_id"), F.col("carried_id").alias("to_id")).unionByName(down).unionByName(up)
    known = symbols.select(F.col("id").alias("node"))
    reached = reach(edges, outside.select(F.col("id").alias("node")).join(known, "node", "left_semi"), only=known).select(F.col("node").alias("id"))
    every = not reached.join(unread.select("id"), "id", "left_semi").isEmpty()
    types = symbols.where(F.col("kind").isin(TYPE_KINDS)).select("id")
    return (types if every else types.join(reached, "id", "left_semi")), every


def visibility_with_unseen(references: DataFrame, symbols: DataFrame, in_graph: DataFrame) -> DataFrame:
    """(id, scope, named): as ``visibility_reach``, but a declaration that is counted more often than the graph holds references to it is named from outside. ``in_graph``: id, counted."""
    at = symbols.select(F.col("id").alias("to_id"), F.col("path").alias("own_path")).distinct()
    rank = F.when(F.col("consumer") != "", 2).when(F.col("path") != F.col("own_path"), 1).otherwise(0)
    seen = references.join(at, "to_id").groupBy(F.col("to_id").alias("id")).agg(F.max(rank).alias("r"), F.count("*").alias("edges"))
    rows = in_graph.join(seen, "id", "full").select("id", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("edges", F.lit(0)).alias("edges"), "r")
    scope = F.when((F.col("counted") > F.col("edges")) | (F.col("r") == 2), "outside").when(F.col("r") == 1, "package").otherwise("file")
    return rows.select("id", scope.alias("scope"), F.greatest("counted", "edges").alias("named")).where("named > 0")


def explained_steps(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, by): for each declaration of depth 1 or more, the first by name of those one step nearer a seed that refer to it: the way back to a seed. ``reached``: node, depth; ``edges``: from_id, to_id."""
    at, before = reached.select(F.col("node").alias("to_id"), "depth"), reached.select(F.col("node").alias("from_id"), (F.col("depth") + 1).alias("depth"))
    return edges.select("from_id", "to_id").distinct().join(at, "to_id").join(before, ["from_id", "depth"]).groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("by"))


def of_decorators(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, class, detail): a decorated declaration, and the members of a decorated class. ``sites``: id, decorator."""
    marks = sites.groupBy("id").agg(F.min("decorator").alias("detail"))
    members = symbols.where(F.col("kind").isin(MEMBERS)).select(F.col("id").alias("member"), F.col("parent").alias("id"))
    inside = marks.join(members, "id").select(F.col("member").alias("id"), "detail")
    return marks.unionByName(inside).groupBy("id").agg(F.min("detail").alias("detail")).select("id", F.lit("decorator").alias("class"), "detail")


def of_serializers(passed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, class, detail): public members of types whose values go to a function that reads them by name. ``passed``: type_id, site."""
    sites = passed.groupBy(F.col("type_id").alias("parent")).agg(F.min("site").alias("detail"))
    return symbols.where(F.col("kind").isin(MEMBERS) & F.col("exported")).join(sites, "parent").select("id", F.lit("serialization-contract").alias("class"), "detail")


def detected(found: list[DataFrame], test_files: DataFrame, symbols: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, test references): what each class found, one record a declaration and class in the vocabulary's order. What only a test is evidence for is no exemption but a reference from test code.

    ``found``: id, class, detail, site_path.
    """
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("class")).cast("int")
    tests = test_files.select(F.col("path").alias("site_path"), F.lit(True).alias("t")).distinct()
    flagged = rows.join(symbols.select("id").distinct(), "id", "left_semi").join(tests, "site_path", "left").withColumn("by_test", F.col("t").isNotNull())
    kept = flagged.groupBy("id", "class").agg(F.bool_and("by_test").alias("by_test"), F.min("detail").alias("detail"))
    records = kept.where("not by_test").withColumn("class_ord", order).select("id", "class", "class_ord", "detail")
    return records, kept.where("by_test").select(F.col("id").alias("to_id"), F.lit(True).alias("test")).distinct()


def configured(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(entry, ids, matched): declarations that configured entries name, by reference or by module and name; an entry that names none is unmatched. ``entries``: entry, ref, module, name. ``symbols``: id, ref, path, name."""
    by_ref = entries.where("ref is not null").join(symbols.select("ref", "id"), "ref").select("entry", "id")
    by_name = entries.where("ref is null").join(symbols.select(F.col("path").alias("module"), "name", "id"), ["module", "name"]).select("entry", "id")
    hits = by_ref.unionByName(by_name).groupBy("entry").agg(F.countDistinct("id").alias("ids"))
    return entries.select("entry").distinct().join(hits, "entry", "left").select("entry", F.coalesce("ids", F.lit(0)).alias("ids"), F.col("ids").isNotNull().alias("matched"))


def bound_symbols(entries: DataFrame, symbols: DataFrame, holder: Column) -> DataFrame:
    """(entry, bound, by_holder): the declarations that an entry's reference and path name; for a code about parts, where there is none, those of the declaration that holds the part it names (``holder``). ``entries``: entry, code, ref, path."""
    at = symbols.select("id", "ref", "path")
    direct = entries.join(at, ["ref", "path"]).select("entry", F.col("id").alias("bound"), F.lit(False).alias("by_holder"))
    rest = entries.where(subject_of("code") == "part").join(direct.select("entry"), "entry", "left_anti").select("entry", "path", holder.alias("ref"))
    return direct.unionByName(rest.join(at, ["ref", "path"]).select("entry", F.col("id").alias("bound"), F.lit(True).alias("by_holder")))


def distinct_bindings(bindings: DataFrame) -> DataFrame:
    """(binding, configurations): each binding document once, whatever the order of configurations that give it, with how many do. ``bindings``: configuration, binding (JSON text)."""
    return bindings.groupBy("binding").agg(F.countDistinct("configuration").alias("configurations"))


def file_last_uses(needs: DataFrame) -> DataFrame:
    """(at, name, path): packages that one file alone needs. ``needs``: at, name, path."""
    return needs.groupBy("at", "name").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")


def facts_document(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """(part, json): the facts document as lines, a line for each generated file and each binding with its carrier's state, in order. ``files``: path; ``bindings``: binding, carrier, state."""
    first = files.select(F.lit("generated").alias("part"), F.col("path").alias("key"), F.to_json(F.struct("path")).alias("json"))
    second = bindings.select(F.lit("binding").alias("part"), F.col("binding").alias("key"), F.to_json(F.struct("binding", "carrier", "state")).alias("json"))
    return first.unionByName(second).orderBy(F.desc("part"), "key").select("part", "json")
