"""Walks that are kept up, walks over nested views, and the paths back, against new walks on drawn graphs."""

import random

import pytest

from quietus.graph.maintain import Maintained
from quietus.graph.tiers import paths_back, tiered_walk
from quietus.graph.walk import steps_of, walk

EDGE = "from_id string, to_id string, reads string, test boolean, guessed boolean, inside boolean"
SEED = "node string, holds boolean, passes boolean"


def drawn(spark, seed, n=24, m=36):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(n)}"
    edges = spark.createDataFrame([(name(), name(), rng.choice(["none", "whole", "passes", "none"]), rng.random() < 0.2, rng.random() < 0.1, rng.random() < 0.97) for _ in range(m)], EDGE)
    exports = spark.createDataFrame([(name(), name()) for _ in range(15)], "id string, child string")
    gates = spark.createDataFrame([(name(), name()) for _ in range(4)], "file string, id string")
    seeds = [(f"n{k}", rng.random() < 0.5, rng.random() < 0.5) for k in rng.sample(range(n), 7)]
    return rng, edges, exports, gates, seeds


def states(df):
    return {(r.node, r.level, r.passing, r.holds) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_kept_up_walks_are_new_walks(spark, seed):
    rng, edges, exports, gates, seeds = drawn(spark, seed)
    frame = lambda rows: spark.createDataFrame(rows, SEED)
    now = set(seeds[:5])
    kept = Maintained(edges, frame(sorted(now)), exports, gates)
    for _ in range(1):
        out = set(rng.sample(sorted(now), min(2, len(now))))
        new = set(rng.sample(seeds, 2))
        kept.change(frame(sorted(new)), frame(sorted(out)) if out else None)
        now = (now - out) | new
        assert states(kept.reached()) == states(walk(edges, frame(sorted(now)), exports, gates))


def test_a_small_change_touches_little(spark):
    """A long chain far from the change is neither taken out nor put back."""
    far = [(f"a{k}", f"a{k + 1}", "none", False, False, True) for k in range(9)]
    near = [("b0", "b1", "none", False, False, True), ("b1", "b2", "none", False, False, True), ("a3", "b2", "none", False, False, True)]
    nothing = spark.createDataFrame([], "id string, child string")
    one = lambda node: spark.createDataFrame([(node, False, True)], SEED)
    kept = Maintained(spark.createDataFrame(far + near, EDGE), one("a0").union(one("b0")), nothing)
    assert kept.touched == 10 + 3
    kept.change(removed=one("b0"))
    assert kept.touched <= 4 and {r.node for r in kept.reached().where("node like 'b%'").collect()} == {"b2"}
    kept.change(added=one("b1"))
    assert kept.touched <= 2 and {r.node for r in kept.reached().where("node like 'b%'").collect()} == {"b1", "b2"}


@pytest.mark.parametrize("seed", range(1))
def test_nested_views_in_one_walk(spark, seed):
    rng, edges, exports, gates, seeds = drawn(spark, seed + 20)
    tier = {s: rng.randrange(4) for s in seeds}
    tier = {s: 0 if not s[1] else max(1, t) if t != 2 else 3 for s, t in tier.items()}
    inner, outer = steps_of(edges, exports, gates)
    got = tiered_walk(inner, outer, spark.createDataFrame([(*s, t) for s, t in tier.items()], SEED + ", tier int"), 2).collect()
    first = {}
    for r in got:
        first[r.node] = min(r.tier, first.get(r.node, 9))
    want = {}
    for view in range(4):
        at = [s for s, t in tier.items() if t <= view]
        for r in walk(edges, spark.createDataFrame(at, SEED), exports, gates if view >= 2 else None).collect():
            want.setdefault(r.node, view)
    assert first == want
    # Every chain starts at a seed, or at what an edge from outside enters, and each of its steps is one of the graph's.
    links = {(r.node, r.to_id) for r in inner.collect()}
    pointers = spark.createDataFrame([tuple(r) for r in got], "node string, tier int, depth int, by string, by_tier int")
    targets = spark.createDataFrame(list(first.items()), "node string, tier int")
    chains = {}
    for r in paths_back(pointers, targets).collect():
        chains.setdefault(r.target, {})[r.place] = r.node
    entries = {s[0] for s in seeds} | {r.node for r in outer.collect()}
    assert chains.keys() == first.keys()
    for target, steps in chains.items():
        chain = [steps[k] for k in range(len(steps))]
        assert chain[-1] == target and chain[0] in entries and all(x in links for x in zip(chain, chain[1:], strict=False))


def test_long_paths_take_few_rounds(spark):
    rows = [("p0", 0, 0, None, None)] + [(f"p{k}", 0, k, f"p{k - 1}", 0) for k in range(1, 200)]
    pointers = spark.createDataFrame(rows, "node string, tier int, depth int, by string, by_tier int")
    got = paths_back(pointers, spark.createDataFrame([("p199", 0), ("p7", 0)], "node string, tier int"), max_rounds=10).collect()
    assert sorted((r.place, r.node) for r in got if r.target == "p199") == [(k, f"p{k}") for k in range(200)]
    assert sum(r.target == "p7" for r in got) == 8
