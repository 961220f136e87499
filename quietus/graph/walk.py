"""Fixpoints over edges: the lattice walk, plain reachability, depths, and greatest fixpoints.

A round joins only what is new (semi-naive) with the edges, which are written once, and what it enters with the state, to which only news is added. What changes is broadcast
where its counted size allows, so neither edges nor state are shuffled in such a round; beyond that the joins are left to the planner. News is cut to the shared folder every
round and the state every few rounds, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.session import cut, kept

BROADCAST_FRONTIER = 100_000
#: Steps that are gone in one query where a graph has no more than so many edges: its rounds cost more in queries than in rows.
HOPS, FEW_STEPS = 3, 5_000_000
REACHED, USED, WHOLE, PASSED = 1, 2, 3, 4


def _joined(frontier: DataFrame, size: int, edges: DataFrame, key: str | list[str]) -> DataFrame:
    return edges.join(F.broadcast(frontier) if size <= BROADCAST_FRONTIER else frontier, key)


def _without(entered: DataFrame, covered: DataFrame, key: list[str], size: int) -> DataFrame:
    return entered.join(F.broadcast(covered) if size <= BROADCAST_FRONTIER else covered, key, "left_anti")


def over(reads: Column, level: Column, passing: Column) -> Column:
    """Level at which an edge enters its target."""
    return F.when(reads == "export", level).when(reads == "gate", USED).when(reads == "passes", F.when(passing, PASSED).when(level >= USED, WHOLE).otherwise(REACHED)).when(reads == "whole", WHOLE).otherwise(REACHED)


def steps_of(edges: DataFrame, exports: DataFrame, gates: DataFrame | None = None, production: bool = True, guessed: bool = False, expands: bool = True) -> tuple[DataFrame, DataFrame]:
    """(steps: node, to_id, reads, test; outer: node, level, passing): the edges inside the graph with what whole reads and gates enter, and what edges from outside enter."""
    usable = edges if guessed else edges.where(~F.col("guessed"))
    # Edges are joined out of all references: once, for both sides, and are distinct where that join left them. What is added differs from them in ``reads``.
    usable = kept(usable.select("from_id", "to_id", "reads", "test", "inside").distinct(), "edges", codec="zstd")
    inner, more = usable.where("inside").select(F.col("from_id").alias("node"), "to_id", "reads", "test"), []
    if expands:
        more.append(exports.select(F.col("id").alias("node"), F.col("child").alias("to_id"), F.lit("export").alias("reads"), F.lit(False).alias("test")))
    if gates is not None:
        more.append(gates.select(F.col("file").alias("node"), F.col("id").alias("to_id"), F.lit("gate").alias("reads"), F.lit(False).alias("test")))
    for rows in more:
        inner = inner.unionByName(kept(rows.distinct(), "steps", codec="zstd"))
    outer = usable.where("not inside" + (" and not test" if production else "")).select("to_id", "reads").distinct()
    first = over(F.col("reads"), F.lit(USED), F.lit(True))
    return inner, outer.select(F.col("to_id").alias("node"), first.alias("level"), (first == PASSED).alias("passing"))


KEY = ["node", "holds"]


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max("level").alias("level"), F.bool_or("passing").alias("passing"), F.min("depth").alias("depth"))


def starts(seeds: DataFrame, outer: DataFrame) -> DataFrame:
    """The states that ``seeds`` (node, holds, passes) and edges from outside begin with."""
    own = seeds.select("node", "holds", F.lit(USED).alias("level"), F.col("passes").alias("passing"))
    return _merged(own.unionByName(outer.select("node", F.lit(False).alias("holds"), "level", "passing")).withColumn("depth", F.lit(0)))


def entered_by(went: DataFrame, depth: int, production: bool) -> DataFrame:
    """The states that steps from the states beside them enter: ``went`` has node, holds, level, passing, to_id, reads, test."""
    went = went.where((F.col("reads") != "export") | (F.col("level") >= WHOLE))
    if production:
        went = went.where("holds or not test")
    level = over(F.col("reads"), F.col("level"), F.col("passing"))
    return _merged(went.select(F.col("to_id").alias("node"), (F.col("holds") | (F.col("reads") == "gate")).alias("holds"), level.alias("level"), (level == PASSED).alias("passing"), F.lit(depth).alias("depth")))


def news(state: DataFrame, entered: DataFrame) -> DataFrame:
    """Those of ``entered`` that ``state`` does not cover. What a state covers is found from the state's side, where it lies; covered keys are no more than those entered."""
    entered = cut(entered)
    size = entered.count()
    known = state.select(*KEY, F.col("level").alias("s_level"), F.col("passing").alias("s_passing"))
    covered = _joined(entered, size, known, KEY).where("s_level >= level and (s_passing or not passing)").select(*KEY).distinct()
    return cut(_without(entered, covered, KEY, size))


def propagate(state: DataFrame, front: DataFrame, inner: DataFrame, production: bool, max_rounds: int = 10_000) -> DataFrame:
    """``state`` with ``front``, which it holds already, carried on along ``inner`` to the fixpoint; a node and tier may have several rows, of which the greatest counts."""
    for k in range(1, max_rounds):
        size = front.count()
        if not size:
            return state
        went = _joined(front.select(*KEY, "level", "passing"), size, inner, "node")
        front = news(state, entered_by(went, k, production))
        state = state.unionByName(front)
        if k % 8 == 0:
            state = cut(_merged(state))
    if not front.isEmpty():
        raise RuntimeError("the walk did not settle within max_rounds")
    return state


def by_node(state: DataFrame) -> DataFrame:
    """(node, level, passing, holds, depth) over both tiers."""
    return state.groupBy("node").agg(F.max("level").alias("level"), F.bool_or("passing").alias("passing"), F.bool_or("holds").alias("holds"), F.min("depth").alias("depth"))


def walk(edges: DataFrame, seeds: DataFrame, exports: DataFrame, gates: DataFrame | None = None, production: bool = True, guessed: bool = False, expands: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """The least fixpoint of the lattice walk: (node, level, passing, holds, depth).

    ``edges``: from_id, to_id, reads, test, guessed, inside. ``seeds``: node, holds, passes. A node's state in a tier is a level (reached, used, whole, passed) and
    whether it passes on what it re-exports; states join component by component. A holding tier follows test edges, the other one only what ``production`` admits. Edges from outside the graph
    enter as from a used, passing caller. A node entered whole or passed enters its exports alike; a gate's seeds join once its file is reached. ``depth`` is the round of first entry.
    """
    inner, outer = steps_of(edges, exports, gates, production, guessed, expands)
    front = cut(starts(seeds, outer))
    return by_node(propagate(front, front, inner, production, max_rounds))


def reach(edges: DataFrame, seeds: DataFrame, src: str = "from_id", dst: str = "to_id", only: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(node, depth): what ``seeds`` (node) reach, and in how many steps; ``only`` (node) restricts what may be entered after the seeds."""
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    if only is not None:
        steps = steps.join(only.select(F.col("node").alias("next")).distinct(), "next", "left_semi")
    # Only what is written is told apart: within the joins that make the edges, an inequality of their ends would be taken for a join's condition, and all pairs met.
    steps = cut(steps).where("node <> next")
    hops = HOPS if steps.count() <= FEW_STEPS else 1
    found = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, size = found, found.count()
    for k in range(1, max_rounds):
        if not size:
            break
        # Some steps in one query: what they enter beyond the first is new only if its way there is.
        hop = _joined(front.select("node"), size, steps, "node").select(F.col("next").alias("node"), F.lit(1).alias("d"))
        entered = hop
        for d in range(2, hops + 1):
            hop = hop.distinct().join(steps, "node").select(F.col("next").alias("node"), F.lit(d).alias("d"))
            entered = entered.unionByName(hop)
        entered = cut(entered.groupBy("node").agg(F.min("d").alias("d")))
        size = entered.count()
        covered = _joined(entered.select("node"), size, found.select("node"), "node").distinct()
        news_ = _without(entered, covered, ["node"], size)
        grown = cut(news_.select("node", (F.col("d") + F.lit((k - 1) * hops)).alias("depth"), (F.col("d") == hops).alias("last")))
        # Nodes that an earlier hop entered have had their own steps taken; only the last hop's are still to go.
        front = grown.where("last").select("node", "depth")
        size = front.count()
        if not grown.isEmpty():
            found = found.unionByName(grown.select("node", "depth"))
            found = found if k % 8 else cut(found)
    else:
        if size:
            raise RuntimeError("reachability did not settle within max_rounds")
    return found


def support_files(uses: DataFrame, tests: DataFrame, rooted: DataFrame, evidence: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(path, support): files only tests reach, none a test or holding a root, whose every user outside the set is a test; greatest fixpoint.

    ``uses``: from_path, to_path. Where ``evidence`` (path) is given, support is the greatest such set of files with evidence.
    """
    reached = reach(uses, tests.select(F.col("path").alias("node")), "from_path", "to_path").select(F.col("node").alias("path"))
    start = reached.join(tests, "path", "left_anti").join(rooted, "path", "left_anti")

    def shrink(files: DataFrame) -> DataFrame:
        files = cut(files)
        n = files.count()
        for _ in range(max_rounds):
            inside = files.unionByName(tests.select("path")).select(F.col("path").alias("from_path")).distinct()
            foreign = uses.join(inside, "from_path", "left_anti").select(F.col("to_path").alias("path")).distinct()
            files = cut(files.join(foreign, "path", "left_anti"))
            left = files.count()
            if left == n:
                break
            n = left
        else:
            raise RuntimeError("support did not settle within max_rounds")
        return files

    only_tests = shrink(start)
    support = shrink(only_tests.join(evidence, "path", "left_semi")) if evidence is not None else only_tests
    return only_tests.join(support.withColumn("support", F.lit(True)), "path", "left").select("path", F.coalesce("support", F.lit(False)).alias("support"))


def peer_closure(needed: DataFrame, peers: DataFrame) -> DataFrame:
    """(name): packages needed, and what their installed peers need in turn."""
    return reach(peers, needed.select(F.col("name").alias("node")), "name", "peer").select(F.col("node").alias("name"))


def carrier_reach(edges: DataFrame, written_by_hand: DataFrame, sealed: DataFrame | None = None) -> DataFrame:
    """(node): what hand-written code carries on: no writes, no test edges, nothing out of a sealed source."""
    steps = edges.where("use <> 'write' and not test")
    if sealed is not None:
        steps = steps.join(sealed.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return reach(steps, written_by_hand.select(F.col("id").alias("node"))).select("node")
