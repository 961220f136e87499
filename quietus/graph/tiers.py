"""One walk for several nested views, with a pointer back from every node, and the paths those pointers give.

Views are nested: each has the seeds of those before it. A state therefore belongs to the first view it comes up in, and holds in all later ones. The walk carries states of all views at once; a state that one of an
earlier view covers is no news. The step by which a node first came up in a view points back to a node of that view or of an earlier one that came up before, so pointers never run in circles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.graph.walk import PASSED, USED, WHOLE, _joined, _without, over
from quietus.session import cut

KEY = ["node", "holds", "tier"]


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max("level").alias("level"), F.bool_or("passing").alias("passing"), F.min("step").alias("step"))


def tiered_walk(inner: DataFrame, outer: DataFrame, seeds: DataFrame, gate_tier: int, production: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(node, tier, depth, by, by_tier): every view in which a node comes up for the first time or by a shorter way of its own, and the step back; a seed's ``by`` is null.

    ``inner``, ``outer``: see ``steps_of``, gates included. ``seeds``: node, holds, passes, tier. A gate opens from the view ``gate_tier`` on.
    """
    none = [F.lit(None).cast("string").alias("by"), F.lit(None).cast("int").alias("by_tier")]
    start = seeds.select("node", "holds", "tier", F.lit(USED).alias("level"), F.col("passes").alias("passing"), F.lit(0).alias("depth"), *none)
    start = start.unionByName(outer.select("node", F.lit(False).alias("holds"), F.lit(0).alias("tier"), "level", "passing", F.lit(0).alias("depth"), *none))
    step = F.struct("depth", "by", "by_tier").alias("step")
    state = front = cut(_merged(start.select(*KEY, "level", "passing", step)))
    for k in range(1, max_rounds):
        size = front.count()
        if not size:
            break
        went = _joined(front.drop("step"), size, inner, "node").where((F.col("reads") != "export") | (F.col("level") >= WHOLE))
        if production:
            went = went.where("holds or not test")
        level = over(F.col("reads"), F.col("level"), F.col("passing"))
        gate = F.col("reads") == "gate"
        entered = went.select(F.col("to_id").alias("node"), (F.col("holds") | gate).alias("holds"), F.when(gate, F.greatest("tier", F.lit(gate_tier))).otherwise(F.col("tier")).alias("tier"), level.alias("level"), (level == PASSED).alias("passing"), F.lit(k).alias("depth"), F.col("node").alias("by"), F.col("tier").alias("by_tier"))
        entered = cut(_merged(entered.select(*KEY, "level", "passing", step)))
        size = entered.count()
        known = state.select("node", "holds", F.col("tier").alias("s_tier"), F.col("level").alias("s_level"), F.col("passing").alias("s_passing"))
        asked = entered.select(*KEY, "level", "passing")
        # A state of an earlier view, or of the same one, covers it.
        covered = _joined(asked, size, known, ["node", "holds"]).where("s_tier <= tier and s_level >= level and (s_passing or not passing)").select(*KEY).distinct()
        front = cut(_without(entered, covered, KEY, size))
        state = state.unionByName(front)
        if k % 8 == 0:
            state = cut(_merged(state))
    else:
        if not front.isEmpty():
            raise RuntimeError("the walk did not settle within max_rounds")
    return state.groupBy("node", "tier").agg(F.min("step").alias("step")).select("node", "tier", "step.depth", "step.by", "step.by_tier")


def paths_back(pointers: DataFrame, targets: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(target, place, node): the chain from a seed (place 0) to each of ``targets`` (node, tier), by ``pointers`` of ``tiered_walk``.

    Pointers are doubled: each round knows the node twice as many steps back, so a path of n steps takes log n rounds, and all targets are followed at once.
    """
    jump = cut(pointers.where("by is not null").select("node", "tier", F.col("by").alias("to"), F.col("by_tier").alias("to_tier")))
    rows = cut(targets.select("node", "tier").distinct().join(pointers.select("node", "tier"), ["node", "tier"]).select(F.col("node").alias("target"), F.lit(0).alias("back"), "node", "tier"))
    for k in range(max_rounds):
        more = cut(rows.join(jump, ["node", "tier"]).select("target", (F.col("back") + F.lit(1 << k)).alias("back"), F.col("to").alias("node"), F.col("to_tier").alias("tier")))
        if more.isEmpty():
            break
        rows = cut(rows.unionByName(more))
        step = jump.select(F.col("node").alias("to"), F.col("tier").alias("to_tier"), F.col("to").alias("next"), F.col("to_tier").alias("next_tier"))
        jump = cut(jump.join(step, ["to", "to_tier"]).select("node", "tier", F.col("next").alias("to"), F.col("next_tier").alias("to_tier")))
    else:
        raise RuntimeError("paths did not end within max_rounds")
    ends = rows.groupBy("target").agg(F.max("back").alias("length"))
    return rows.join(ends, "target").select("target", (F.col("length") - F.col("back")).alias("place"), "node")
