"""What a consumer can name, against a plain walk that follows the rules one declaration at a time."""

import random

import pytest
from pyspark.sql import functions as F

from quietus.operators import surface
from quietus.plans import analysis

SYMBOLS = "id string, kind string, parent string, path string, name string, exported boolean, visibility string, type_only boolean, global_block boolean"


def plain(symbols, uses, inferred, seeds, files):
    """(reached, guessed): a worklist, with global blocks looked at again whenever it runs out."""
    by_id, reached, entered, guessed = {s["id"]: s for s in symbols}, set(), set(), set()
    pending = []

    def reach(i):
        if i in by_id:
            into = entered if by_id[i]["kind"] == "file" else reached
            if i not in into:
                into.add(i)
                pending.append(i)

    for i in seeds:
        reach(i)
    while True:
        while pending:
            at = by_id[pending.pop()]
            for m in symbols:
                shown = m["exported"] if at["kind"] in ("file", "namespace") else m["visibility"] not in ("private", "private-name")
                if m["parent"] == at["id"] and m["kind"] != "type-parameter" and shown and not m["type_only"]:
                    reach(m["id"])
            for a, b, name in uses:
                if a == at["id"] and at["kind"] != "file":
                    for target in [b] if b else [s["id"] for s in symbols if s["name"] == name]:
                        reach(target)
                        if not b and by_id[target]["kind"] != "file":
                            guessed.add(target)
            for a, b, member in inferred:
                if a == at["id"] and (not member or by_id[b]["visibility"] in ("public", "protected")):
                    reach(b)
        typed = {by_id[i]["path"] for i in [*reached, *files]}
        for block in symbols:
            if block["global_block"] and block["path"] in typed:
                reach(block["id"])
                for m in symbols:
                    if m["parent"] == block["id"] and m["kind"] != "type-parameter":
                        reach(m["id"])
        if not pending:
            return reached, guessed


@pytest.mark.parametrize("seed", range(3))
def test_published_api_matches_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    symbols = [dict(id=f"f{k}", kind="file", parent="", path=f"p{k}", name=f"f{k}", exported=False, visibility="public", type_only=False, global_block=False) for k in range(4)]
    for k in range(40):
        holder = rng.choice(symbols)
        kind = rng.choice(["class", "namespace", "type", "type-parameter", "method", "function"])
        block = kind == "namespace" and holder["kind"] == "file" and rng.random() < 0.5
        symbols.append(dict(id=f"s{k}", kind=kind, parent=holder["id"], path=holder["path"], name=f"n{k % 25}", exported=rng.random() < 0.5, visibility=rng.choice(["public", "public", "protected", "private", "private-name"]), type_only=rng.random() < 0.1, global_block=block))
    ids = [s["id"] for s in symbols]
    uses = [(rng.choice(ids), rng.choice([*ids, None, None]), f"n{rng.randrange(30)}") for _ in range(14)]
    inferred = [(rng.choice(ids), rng.choice(ids), rng.random() < 0.5) for _ in range(4)]
    exports, files, tagged = [(rng.choice(ids[:4]), rng.choice(ids[4:])) for _ in range(5)], [rng.choice(ids[:4])], [rng.choice(ids[4:]) for _ in range(2)]
    seeds = [i for f, i in exports if f in files] + [t for t in tagged if next(s for s in symbols if s["id"] == t)["exported"]]
    reached, guessed = plain(symbols, uses, inferred, seeds, [next(s for s in symbols if s["id"] == f)["id"] for f in files])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    facts = frame([tuple(s.values()) for s in symbols], SYMBOLS)
    got = surface.published_api(facts, frame(uses, "from_id string, to_id string, name string"), frame([(f,) for f in files], "id string"), frame(exports, "file string, id string"), frame([(t,) for t in tagged], "id string"), frame(inferred, "from_id string, to_id string, member boolean")).collect()
    assert {r.id for r in got} == reached and len(got) == len(reached)
    assert {r.id for r in got if r.guessed} == guessed & reached


def test_release_tags(spark):
    rows = [("/** @public */", True), ("/** a\n * @beta\n */\n", True), ("/** @alphabet */", False), ("/** @public */ x", False), ("/** @public */ /** b */", False), ("/* @public */", False), ("/** a /** @alpha */", True), (None, False)]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    assert [r.y for r in frame.select("k", surface.release_tagged(F.col("t")).alias("y")).orderBy("k").collect()] == [y for _, y in rows]


def test_analysis_takes_what_consumers_can_name_as_roots(spark):
    symbols = spark.createDataFrame([("f", "file", "a.ts", "", False, "a"), ("c", "class", "a.ts", "f", True, "C"), ("t", "type", "b.ts", "g", True, "T"), ("g", "file", "b.ts", "", False, "b"), ("x", "type", "b.ts", "g", True, "X")], "id string, kind string, path string, parent string, exported boolean, name string")
    given = {"symbols": symbols, "roots": spark.createDataFrame([], "id string, kind string"), "published": spark.createDataFrame([("f",)], "id string"), "published_exports": spark.createDataFrame([("f", "c")], "file string, id string"), "type_uses": spark.createDataFrame([("c", "t", "T")], "from_id string, to_id string, name string")}
    assert {(r.id, r.kind) for r in analysis.with_published(given)["roots"].collect()} == {("f", "published-api"), ("c", "published-api"), ("t", "published-api")}
    assert analysis.with_published({"symbols": symbols}) == {"symbols": symbols}


def test_reach_leaves_the_joins_of_its_edges_alone(spark, monkeypatch):
    from quietus.graph import walk

    plans, cut = [], walk.cut
    monkeypatch.setattr(walk, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    edges = spark.sql("SELECT concat('a', x.id) AS from_id, concat('b', y.id) AS to_id FROM {x} x CROSS JOIN (SELECT count(*) AS n FROM {y}) z JOIN {y} y ON x.id % z.n = y.id UNION ALL SELECT 'b1', 'b1'", x=spark.range(9), y=spark.range(5))
    assert {(r.node, r.depth) for r in walk.reach(edges, spark.createDataFrame([("a6",)], "node string")).collect()} == {("a6", 0), ("b1", 1)}
    assert "NOT (concat" not in plans[0]
