"""A finished walk that is kept up while seeds come and go.

New seeds are carried on from the state as it is. For seeds that go, what they may have entered is taken out first, along the steps, and what else enters it is put back: from states that stay, from seeds that stay, and
from outside. Either way a round joins only what changes, so a small change costs little, whatever the graph's size; the result is that of a new walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.graph.walk import KEY, _joined, _merged, _without, by_node, entered_by, news, propagate, starts, steps_of
from quietus.session import cut

SEED = [*KEY, "passes"]


class Maintained:
    """The walk of ``edges`` from ``seeds`` (node, holds, passes), see ``walk``; ``change`` moves it on. ``touched`` is how many states the last change took out or put in."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, exports: DataFrame, gates: DataFrame | None = None, production: bool = True, guessed: bool = False):
        self.production = production
        self.inner, outer = steps_of(edges, exports, gates, production, guessed)
        self.outer = cut(outer)
        self.back = self.inner.withColumnsRenamed({"node": "from_id", "to_id": "node"})
        self.seeds = cut(seeds.select(*SEED).distinct())
        front = cut(starts(self.seeds, self.outer))
        self.state = cut(_merged(propagate(front, front, self.inner, production)))
        self.touched = self.state.count()

    def reached(self) -> DataFrame:
        """(node, level, passing, holds) of the walk as it is now."""
        return by_node(self.state).drop("depth")

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Take out the seeds ``removed`` and put in the seeds ``added`` (node, holds, passes). A seed that is in both stays."""
        none = self.seeds.limit(0)
        added = none if added is None else cut(added.select(*SEED).distinct())
        removed = none if removed is None else cut(removed.select(*SEED).distinct().join(added, SEED, "left_anti").join(self.seeds, SEED, "left_semi"))
        self.touched = 0
        left = cut(self.seeds.join(removed, SEED, "left_anti").unionByName(added).distinct())
        if not removed.isEmpty():
            self._take_out(removed, left)
        if not added.isEmpty():
            front = news(self.state, starts(added, self.outer.limit(0)))
            self._carry_on(front)
        self.seeds = left

    def _carry_on(self, front: DataFrame) -> None:
        before = self.state.count()
        grown = propagate(self.state.unionByName(front), front, self.inner, self.production)
        self.touched += grown.count() - before
        self.state = cut(_merged(grown))

    def _take_out(self, removed: DataFrame, left: DataFrame) -> None:
        gone = self._after(removed.select(*KEY).distinct())
        size = gone.count()
        self.touched += size
        stays = cut(_without(self.state, gone, KEY, size))
        # What else enters the states taken out: only steps into them are looked at.
        into = _joined(gone.select("node").distinct(), size, self.back, "node")
        sources = stays.select(F.col("node").alias("from_id"), "holds", "level", "passing")
        went = sources.join(into.withColumnRenamed("node", "to_id"), "from_id").withColumnRenamed("from_id", "node")
        again = entered_by(went, 0, self.production).unionByName(starts(left, self.outer))
        again = cut(_merged(_joined(gone, size, again, KEY)))
        self.state = stays
        self._carry_on(again)

    def _after(self, keys: DataFrame, max_rounds: int = 10_000) -> DataFrame:
        """(node, holds): ``keys`` and all states of the walk that steps from them lead to, at whatever level."""
        held = self.state.select(*KEY)
        found = front = cut(_joined(keys, keys.count(), held, KEY))
        for _ in range(max_rounds):
            size = front.count()
            if not size:
                return found
            went = _joined(front, size, self.inner, "node")
            if self.production:
                went = went.where("holds or not test")
            to = cut(went.select(F.col("to_id").alias("node"), (F.col("holds") | (F.col("reads") == "gate")).alias("holds")).distinct())
            size = to.count()
            front = cut(_without(_joined(to, size, held, KEY), found, KEY, size))
            found = found.unionByName(front)
        raise RuntimeError("the states to take out did not settle within max_rounds")
