"""Judging declarations: what is live under each relation, what is dead, tests of dead code, components of dead code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.graph.components import weak_components
from quietus.graph.edges import counted_refs, graph_edges, reference_counts, whole_reads
from quietus.graph.scc import referenced_cycles, strong_components
from quietus.graph.tiers import paths_back, tiered_walk
from quietus.graph.walk import PASSED, reach, steps_of, walk
from quietus.operators.evidence import whole_reads_of_groups
from quietus.operators.joins import gap_and_island_lines
from quietus.session import cut

#: Root kinds that name no caller.
CALLERLESS = ["published-api"]


def exports_of(symbols: DataFrame) -> DataFrame:
    """(id, child): what a whole read of a declaration enters. Merged declarations read as one where the facts tell them (ref, is_static, block); else only files have exports."""
    return whole_reads_of_groups(symbols) if {"ref", "is_static", "block"} <= set(symbols.columns) else whole_reads(symbols)


def sweep_reach(symbols: DataFrame, references: DataFrame, roots: DataFrame, held: DataFrame, gates: DataFrame | None = None, production: bool = True, guessed: bool = False) -> DataFrame:
    """The walk of one view: roots are used and pass on; held seeds are used in the holding tier."""
    known = symbols.select(F.col("id").alias("node")).distinct()
    seeds = roots.select(F.col("id").alias("node"), F.lit(False).alias("holds"), F.lit(True).alias("passes")).unionByName(held.select(F.col("id").alias("node"), F.lit(True).alias("holds"), F.lit(False).alias("passes"))).join(known, "node", "left_semi").distinct()
    gates = None if gates is None else gates.join(known.withColumnRenamed("node", "file"), "file", "left_semi")
    # What is no declaration goes from the nodes reached, which are few, and not from the references: all of them would be shuffled for it.
    reached = walk(graph_edges(references, symbols, targets=False), seeds, exports_of(symbols), gates, production, guessed)
    return reached.join(known, "node", "left_semi")


def judge(symbols: DataFrame, references: DataFrame, roots: DataFrame, held: DataFrame, exempt: DataFrame, gates: DataFrame | None = None, production: bool = True, reached: DataFrame | None = None) -> DataFrame:
    """(id, kind, path, line, end_line, parent, exported, name, counted, production, test, live_counting, live_reach, dead, relation) of every declaration. ``gates`` (file, id): declarations kept while their file is reached."""
    reached = sweep_reach(symbols, references, roots, held, gates, production) if reached is None else reached
    if gates is not None:  # what an opened gate holds is exempt, as a record's declaration is
        opened = gates.join(reached.select(F.col("node").alias("file")), "file", "left_semi").select("id")
        exempt = exempt.select("id").unionByName(opened)
    called = roots.where(~F.col("kind").isin(CALLERLESS)).select("id").distinct().withColumn("called", F.lit(True))
    rows = symbols.join(reference_counts(references, symbols), "id", "left").na.fill(0, ["production", "test", "consumer_test", "guessed_refs"])
    rows = rows.join(reached.select(F.col("node").alias("id"), "level"), "id", "left").join(called, "id", "left").join(exempt.select("id").distinct().withColumn("exempt", F.lit(True)), "id", "left")
    rows = rows.withColumn("counted", counted_refs(production)).withColumn("live_counting", F.coalesce("called", F.lit(False)) | (F.col("counted") > 0) | (F.coalesce("level", F.lit(0)) == PASSED)).withColumn("live_reach", F.col("level").isNotNull())
    dead = (F.col("kind") != "file") & F.col("exempt").isNull() & ~(F.col("live_counting") & F.col("live_reach"))
    return rows.withColumn("dead", dead).withColumn("relation", F.when(F.col("counted") == 0, "reference-counting").otherwise("reachability")).drop("level", "called", "exempt", "guessed_refs", "consumer_test")


def tests_of_dead_code(edges: DataFrame, test_code: DataFrame, support: DataFrame, dead: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id): test declarations whose production targets are non-empty and all dead, and that share no support with a test of something live.

    ``edges`` (from_id, to_id); ``test_code`` (id) holds support as well; ``subjects`` (id) are the judged declarations.
    """
    mine = edges.join(test_code.select(F.col("id").alias("from_id")), "from_id", "left_semi").distinct()
    targets = mine.join(subjects.select(F.col("id").alias("to_id")), "to_id", "left_semi").join(test_code.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    flagged = targets.join(dead.select(F.col("id").alias("to_id"), F.lit(True).alias("dead")), "to_id", "left")
    judged = cut(flagged.groupBy("from_id").agg(F.bool_and(F.coalesce("dead", F.lit(False))).alias("all_dead")))
    helped = mine.join(support.select(F.col("id").alias("to_id")), "to_id", "left_semi").where("from_id <> to_id")
    shared = helped.join(judged.where("not all_dead").select("from_id"), "from_id", "left_semi").select("to_id").distinct()
    sharing = helped.join(shared, "to_id", "left_semi").select("from_id").distinct()
    return judged.where("all_dead").join(sharing, "from_id", "left_anti").select(F.col("from_id").alias("id"))


def kept_by_tests(edges: DataFrame, reached_tests: DataFrame, admitted: DataFrame) -> DataFrame:
    """(id): what reached, not admitted test code references along test edges."""
    sources = reached_tests.select("id").join(admitted.select("id"), "id", "left_anti").select(F.col("id").alias("from_id"))
    return edges.where("test").join(sources, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()


def test_used_reach(edges: DataFrame, seeds: DataFrame, dead: DataFrame) -> DataFrame:
    """(id): dead declarations that the seeds are or reach through dead declarations."""
    only = dead.select(F.col("id").alias("node"))
    return reach(edges, seeds.select(F.col("id").alias("node")), only=only).join(only, "node", "left_semi").select(F.col("node").alias("id"))


def dead_subgraph(judged: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst) among the dead: references, and the cycle between a dead member and its dead container."""
    dead = judged.where("dead").select("id")
    a, b = dead.withColumnRenamed("id", "src"), dead.withColumnRenamed("id", "dst")
    used = references.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).join(a, "src", "left_semi").join(b, "dst", "left_semi")
    held = judged.where("dead").select(F.col("id").alias("src"), F.col("parent").alias("dst")).join(b, "dst", "left_semi")
    return used.unionByName(held).unionByName(held.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(judged: DataFrame, references: DataFrame) -> DataFrame:
    """(component, id, root, lines): dead declarations by component, numbered by their smallest member; ``lines`` is what the component deletes.

    A root is a member no other cycle of the component refers to and whose container is not dead.
    """
    judged = cut(judged)
    dead = judged.where("dead")
    edges = cut(dead_subgraph(judged, references))
    loops = edges.unionByName(dead.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    groups = cut(weak_components(loops))
    cycles = cut(strong_components(loops))
    entered = referenced_cycles(edges, cycles).withColumn("entered", F.lit(True))
    rows = dead.join(groups.select(F.col("node").alias("id"), F.col("root").alias("component")), "id").join(cycles.select(F.col("node").alias("id"), "scc"), "id").join(entered, "scc", "left")
    inside = dead.select(F.col("id").alias("parent"), F.lit(True).alias("in_dead"))
    rows = rows.join(inside, "parent", "left").withColumn("root", F.col("entered").isNull() & F.col("in_dead").isNull())
    return rows.select("component", "id", "root").join(gap_and_island_lines(rows, ["component"]), "component")


def numbered(components_: DataFrame, product: str = "ts") -> DataFrame:
    """Adds component_id, ``<product>/c-0001`` by the component's smallest member. Numbers come from counts of ranges, so no task sorts all components."""
    names = components_.select("component").distinct()
    parts = cut(names.repartitionByRange("component").sortWithinPartitions("component").withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map().cast("map<int,int>")
    number = (F.col("k") + start[F.col("part")] + 1).cast("long")
    return components_.join(parts.select("component", F.format_string(f"{product}/c-%04d", number).alias("component_id")), "component")


def seeds_of(records: DataFrame, symbols: DataFrame, unanswered: DataFrame) -> DataFrame:
    """(id, tier, file): how each exemption record of a known declaration holds it: gated (while the file it names is live), unanswered, or record; beside the declarations a question about which went unanswered.

    ``records``: id, while_live (a path or null), unanswered. A gate on a path that is no file of the run holds nothing.
    """
    known = symbols.select("id").distinct()
    files = symbols.where("kind = 'file'").select(F.col("path").alias("while_live"), F.col("id").alias("file")).distinct()
    rows = records.join(known, "id", "left_semi").join(files, "while_live", "left")
    tier = F.when(F.col("while_live").isNotNull(), F.when(F.col("file").isNotNull(), "gated")).when(F.coalesce("unanswered", F.lit(False)), "unanswered").otherwise("record")
    own = rows.select("id", tier.alias("tier"), F.when(F.col("while_live").isNotNull(), F.col("file")).alias("file")).where("tier is not null")
    asked = unanswered.select("id").join(known, "id", "left_semi").select("id", F.lit("unanswered").alias("tier"), F.lit(None).cast("string").alias("file"))
    return own.unionByName(asked).distinct()


#: The views that say why a declaration stays, each with the seeds of those before it. Fixed values.
TIERS = ["live", "record", "gated", "unanswered"]


def tier_walk(symbols: DataFrame, references: DataFrame, roots: DataFrame, seeds: DataFrame, production: bool = True) -> DataFrame:
    """(node, tier, depth, by, by_tier): one walk over all of TIERS, and the steps back. ``seeds``: id, tier, file (of a gate)."""
    known = symbols.select(F.col("id").alias("node")).distinct()
    gates = seeds.where("tier = 'gated'").select("file", "id").distinct()
    inner, outer = steps_of(graph_edges(references, symbols), exports_of(symbols), gates, production)
    own = roots.select(F.col("id").alias("node"), F.lit(False).alias("holds"), F.lit(True).alias("passes"), F.lit(0).alias("tier"))
    at = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")).cast("int") - 1
    held = seeds.where("tier <> 'gated'").select(F.col("id").alias("node"), F.lit(True).alias("holds"), F.lit(False).alias("passes"), at.alias("tier"))
    return tiered_walk(inner, outer, own.unionByName(held).join(known, "node", "left_semi").distinct(), TIERS.index("gated"), production)


def tiers(symbols: DataFrame, references: DataFrame, roots: DataFrame, seeds: DataFrame, production: bool = True, walked: DataFrame | None = None) -> DataFrame:
    """(id, tier): why each declaration that any view reaches stays: live (without any seed), record, gated, or unanswered; the first that reaches it."""
    walked = tier_walk(symbols, references, roots, seeds, production) if walked is None else walked
    first = walked.groupBy(F.col("node").alias("id")).agg(F.min("tier").alias("tier")).join(symbols.select("id").distinct(), "id", "left_semi")
    return first.select("id", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("tier"))


def explained_paths(walked: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, place, step): the shortest chain of declarations from a seed to each of ``targets`` (id) in the first view that reaches it."""
    first = walked.groupBy("node").agg(F.min("tier").alias("tier")).join(targets.select(F.col("id").alias("node")), "node", "left_semi")
    return paths_back(walked, first).select(F.col("target").alias("id"), "place", F.col("node").alias("step"))


def components_with_files(judged: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """``components`` with the files (id) that are reported dead among the dead: a file takes the declarations it holds, and what only its top level references, with it."""
    gone = files.select("id", F.lit(True).alias("gone")).distinct()
    rows = judged.join(gone, "id", "left").withColumn("dead", F.col("dead") | F.coalesce("gone", F.lit(False))).drop("gone")
    return components(rows, references)


def placed(findings: DataFrame, components_: DataFrame, falls_with: DataFrame) -> DataFrame:
    """(finding, component): the component of each finding's declaration, components that a finding falls with joined to one of the smallest name.

    ``findings``: finding, declaration. ``components_``: id, component. ``falls_with``: finding, id.
    """
    place = components_.select(F.col("id").alias("declaration"), "component")
    met = falls_with.join(place.withColumnRenamed("declaration", "id"), "id").groupBy("finding").agg(F.min("component").alias("least"))
    ties = falls_with.join(place.withColumnRenamed("declaration", "id"), "id").join(met, "finding").select(F.col("component").alias("src"), F.col("least").alias("dst"))
    joined_ = weak_components(ties).select(F.col("node").alias("component"), F.col("root").alias("joined"))
    at = findings.join(place, "declaration", "left").join(met, "finding", "left").withColumn("component", F.coalesce("component", "least"))
    return at.join(joined_, "component", "left").select("finding", F.coalesce("joined", "component").alias("component"))


def possibly_loaded(edges: DataFrame, seeds: DataFrame, dead: DataFrame) -> DataFrame:
    """(id): the seeds, and the dead declarations that they reach through dead ones: dead only while nothing unseen loads them."""
    found = reach(edges, seeds.select(F.col("id").alias("node")), only=dead.select(F.col("id").alias("node")))
    return found.select(F.col("node").alias("id"))
