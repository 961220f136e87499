"""Operators on literal facts, and properties that hold whatever the facts."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quietus.functions import globs, paths, schema, semver, template, text
from quietus.graph import edges, matrix
from quietus.graph.components import weak_components
from quietus.graph.scc import referenced_cycles, strong_components
from quietus.graph.walk import reach, steps_of, support_files, walk
from quietus.operators import carriers, exemptions, joins, liveness, rules, selfcheck
from quietus.plans import analysis, queries
from quietus.sources import manifests, tree

EDGE = "from_id string, to_id string, reads string, test boolean, guessed boolean, inside boolean"


def pairs(rows, *names):
    return {tuple(r[n] for n in names) for r in rows}


def brute_reach(links, seeds):
    found, queue = set(seeds), list(seeds)
    while queue:
        at = queue.pop()
        for a, b in links:
            if a == at and b not in found:
                found.add(b)
                queue.append(b)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_components_and_reach_match_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(25), rng.randrange(25)) for _ in range(28)]
    frame = spark.createDataFrame(links, "src long, dst long")
    both = links + [(b, a) for a, b in links]
    weak = {r.node: r.root for r in weak_components(frame).collect()}
    strong = {r.node: r.scc for r in strong_components(frame).collect()}
    closure = {n: brute_reach(links, [n]) for n in weak}
    assert weak == {n: min(brute_reach(both, [n])) for n in {x for e in links for x in e}}
    assert strong == {n: min(m for m in closure[n] if n in closure[m]) for n in weak}
    entered = {strong[b] for a, b in links if strong[a] != strong[b]}
    got = referenced_cycles(frame, spark.createDataFrame(list(strong.items()), "node long, scc long"))
    assert {r.scc for r in got.collect()} == entered
    start = spark.createDataFrame([(links[0][0],)], "node long")
    assert {r.node for r in reach(frame, start, "src", "dst").collect()} == closure[links[0][0]]


def test_components_of_odd_edges(spark):
    got = weak_components(spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4), (5, 4)], "src long, dst long"))
    assert pairs(got.collect(), "node", "root") == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}
    assert weak_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def brute_walk(links, seeds, exports, production):
    """States one by one, without merging."""
    over = lambda reads, level, passing: 4 if reads == "passes" and passing else 3 if reads == "whole" or reads == "passes" and level >= 2 else 1
    states, queue = set(), [(n, h, 2, p) for n, h, p in seeds] + [(b, False, over(r, 2, True), over(r, 2, True) == 4) for a, b, r, t, g, inside in links if not inside and not g and not (production and t)]
    while queue:
        s = queue.pop()
        if s in states:
            continue
        states.add(s)
        node, holds, level, passing = s
        if level >= 3:
            queue += [(c, holds, level, level == 4) for f, c in exports if f == node]
        for a, b, r, t, g, inside in links:
            if inside and a == node and not g and (holds or not production or not t):
                queue.append((b, holds, over(r, level, passing), over(r, level, passing) == 4))
    return {n: max(level for m, _, level, _ in states if m == n) for n, *_ in states}


@pytest.mark.parametrize("seed", range(4))
def test_walk_matches_unmerged_states(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(10)]
    links = [(rng.choice(nodes), rng.choice(nodes), rng.choice(["whole", "passes", "none"]), rng.random() < 0.3, rng.random() < 0.1, rng.random() < 0.9) for _ in range(16)]
    exports = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(4)]
    seeds = [(rng.choice(nodes), False, True), (rng.choice(nodes), True, False)]
    for production in (True, False):
        got = walk(spark.createDataFrame(links, EDGE), spark.createDataFrame(seeds, "node string, holds boolean, passes boolean"), spark.createDataFrame(exports, "id string, child string"), production=production)
        assert {r.node: r.level for r in got.collect()} == brute_walk(links, seeds, exports, production)


def test_gates_open_once_reached(spark):
    links = spark.createDataFrame([("a", "f", "whole", False, False, True), ("m", "x", "whole", True, False, True)], EDGE)
    gates = spark.createDataFrame([("f", "m"), ("closed", "n")], "file string, id string")
    seeds = spark.createDataFrame([("a", False, True)], "node string, holds boolean, passes boolean")
    got = walk(links, seeds, spark.createDataFrame([], "id string, child string"), gates)
    assert {r.node for r in got.collect()} == {"a", "f", "m", "x"}  # the gate's seed holds, so it follows a test edge


def test_first_configuration_gives_the_multiset(spark):
    rows = [("y1", 1, 10), ("y1", 1, 11), ("y2", 2, 20), ("y2", 2, 21), ("y2", 2, 22)]
    frame = spark.createDataFrame([(c, k, o, "", "a", "b", "p", 1, 1, "read") for c, k, o in rows], "configuration string, config_ord int, ref_ord long, consumer string, from_id string, to_id string, path string, line int, col int, use string")
    assert pairs(matrix.merge_references(frame).collect(), "ref_ord", "makers") == {(10, "y1,y2"), (11, "y1,y2")}


def project(spark):
    """f holds main -> used -> helper; dead and its caller form a cycle; t is a test of dead code; e is exempt."""
    symbols = [("f", "file", 1, 90, "", False), ("main", "function", 2, 4, "f", True), ("used", "function", 5, 9, "f", False), ("helper", "class", 10, 12, "f", False), ("dead", "function", 20, 25, "f", True), ("pal", "function", 24, 30, "f", False), ("e", "function", 40, 41, "f", False), ("memb", "method", 26, 27, "pal", False), ("onlytest", "function", 50, 52, "f", False), ("t", "function", 60, 66, "f", False)]
    refs = [("main", "used", False), ("used", "helper", False), ("dead", "pal", False), ("pal", "dead", False), ("t", "onlytest", True)]
    facts = {
        "symbols": spark.createDataFrame([(i, k, "f.ts", a, b, p, x, i) for i, k, a, b, p, x in symbols], "id string, kind string, path string, line int, end_line int, parent string, exported boolean, name string"),
        "references": spark.createDataFrame([(a, b, "read", t, False, False, False, "", "f.ts", 1) for a, b, t in refs], "from_id string, to_id string, use string, test boolean, guessed boolean, namespace boolean, reexport boolean, consumer string, path string, line int"),
        "roots": spark.createDataFrame([("main", "configured")], "id string, kind string"),
        "held_seeds": spark.createDataFrame([], "id string"),
        "exempt": spark.createDataFrame([("e",)], "id string"),
    }
    return facts


def test_analyze_explain_and_renderings(spark, tmp_path):
    facts = project(spark)
    got = analysis.analyze(facts)
    assert pairs(got.judged.where("dead").collect(), "id") == {("dead",), ("pal",), ("memb",), ("onlytest",), ("t",)}
    codes = {r.declaration: r.code for r in got.findings.collect()}
    # A member of a dead container falls with it, and what is entered by name is not narrowed.
    assert codes == {"dead": "DS1001", "pal": "DS1002", "onlytest": "DS1102", "t": "DS1002"}
    lines = {r.id: (r.component_id, r.lines) for r in got.components.collect()}
    assert lines["dead"] == lines["pal"] == lines["memb"] and lines["dead"][1] == 11
    confidence = {r.declaration: r.confidence for r in got.findings.collect()}
    assert confidence["dead"] == "probable" and confidence["t"] == "certain" and got.exit_code == 1
    assert {r.id: r.state for r in analysis.explain(got, "used").collect()} == {"used": "live"} and analysis.path_to(facts, "helper") == ["main", "used", "helper"] and analysis.path_to(facts, "dead") == []
    document = json.loads(analysis.report(got.findings).first()["json"])
    assert not schema.refusals(document, analysis.REPORT_SCHEMA) and len(document["findings"]) == got.findings.where("not withheld").count()
    said = analysis.rendered(got.findings, "{{range .findings}}{{.code}} {{.ref}}\n{{else}}none{{end}}")
    assert said.count("\n") == len(document["findings"])
    for form in analysis.RENDERINGS:
        analysis.write(got.findings, form, str(tmp_path / form))
        assert spark.read.text(str(tmp_path / form)).count() >= 1
    lines_of = [r.value for f in sorted((tmp_path / "json").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert json.loads("\n".join(lines_of))["findings"] == document["findings"]
    log = json.loads(rules.sarif(got.findings).first()["sarif"])
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == len(document["findings"])
    assert "production\ttrue" in analysis.configuration_lines(analysis.Config()) and len(analysis.describe()) == len(rules.KINDS)


def test_codes_beyond_the_sweep(spark):
    facts = project(spark)
    none = lambda schema_: spark.createDataFrame([], schema_)
    more = {
        "deprecated": spark.createDataFrame([("onlytest",)], "id string"),
        "parts": spark.createDataFrame([("used", "parameter", "p", False, True, None, False, False), ("used", "result", "", False, False, None, False, False), ("dead", "parameter", "q", False, False, None, False, False)], "declaration string, kind string, name string, in_value boolean, counted boolean, annotated string, before_a_read boolean, contextual boolean"),
        "signatures": spark.createDataFrame([("used", "free"), ("dead", "free")], "declaration string, state string"),
        "calls": spark.createDataFrame([("used", "discarded")], "declaration string, use string"),
        "imports": spark.createDataFrame([("f", "fs", False, "f.ts", 3), ("f", "os", True, "f.ts", 4)], "declaration string, name string, in_use boolean, path string, line int"),
        "dependencies": spark.createDataFrame([("", "left-pad"), ("", "kept")], "dir string, name string"),
        "needs": spark.createDataFrame([("", "kept", "main")], "at string, name string, owner string"),
        "written_records": spark.createDataFrame([(1, "ts://x", " ", "", "ignore.json")], "record_ord long, symbol string, reason string, path string, site_path string"),
        "asked_roots": spark.createDataFrame([("ts://gone",)], "source string"),
        "matched_roots": none("project string, source string, found long"),
        "tree": spark.createDataFrame([("f.ts",), ("g.ts",)], "path string"),
        "records": spark.createDataFrame([("pal", None, False)], "id string, while_live string, unanswered boolean"),
    }
    got = analysis.analyze(facts | more, analysis.Config(complete_matrix=True))
    found = sorted((r.code, r.ref) for r in got.findings.collect())
    # An exemption record keeps pal, and with it dead, which pal uses; deprecation comes before use by tests.
    assert found == sorted([
        ("DS1104", "ts://f.ts#onlytest"), ("DS1002", "ts://f.ts#t"), ("DS1003", "ts://f.ts#memb"), ("DS1503", "ts://f.ts#dead"), ("DS1401", "ts://f.ts#used(p)"), ("DS1401", "ts://f.ts#dead(q)"), ("DS1403", "ts://f.ts#used()"),
        ("DS1004", "ts://f.ts#fs"), ("DS1701", "ts://package.json#left-pad"), ("DS9001", "ts://x"), ("DS9002", "ts://x"), ("DS9004", "ts://gone"), ("DS1601", "ts://g.ts"),
    ])
    hidden = analysis.analyze(facts | {"skipped": spark.createDataFrame([("f.ts", 18, 30)], "path string, from_line int, to_line int")})
    assert {r.declaration for r in hidden.findings.collect()} == {"onlytest", "t"}


def test_an_opened_gate_exempts_what_it_holds(spark):
    facts = project(spark)
    gates = spark.createDataFrame([("f", "onlytest"), ("none", "t")], "file string, id string")
    reaching = facts["references"].unionByName(facts["references"].where("to_id = 'used'").withColumn("to_id", F.lit("f")))
    judged = liveness.judge(facts["symbols"], reaching, facts["roots"], facts["held_seeds"], facts["exempt"], gates)
    assert not {"onlytest"} & {r.id for r in judged.where("dead").collect()} and "t" in {r.id for r in judged.where("dead").collect()}


def test_baseline_asks_the_analysis_again_and_raises(spark):
    kind = "code string, ref string, path string, withheld boolean"
    rows = lambda *refs: spark.createDataFrame([("DS1001", r, "p", False) for r in refs], kind)
    held = rows("a", "b").drop("withheld")
    run = lambda now: rows("a", "c") if now.where("ref = 'b'").isEmpty() else rows("a")
    assert {r.ref for r in rules.baseline_fixpoint(run, held).collect()} == {"a", "c"}
    flips = iter(range(1000))
    with pytest.raises(RuntimeError):
        rules.baseline_fixpoint(lambda now: rows(f"r{next(flips)}"), held, max_rounds=4).collect()


@pytest.fixture
def light(monkeypatch):
    """Analyses without components, and with the findings of one emitter."""
    monkeypatch.setattr(analysis, "EMITTERS", {"dead": analysis.EMITTERS["dead"]})
    alone = lambda judged, references, files: judged.where("dead").select(F.col("id").alias("component"), "id", F.lit(True).alias("root"), F.lit(1).cast("long").alias("lines"))
    monkeypatch.setattr(liveness, "components_with_files", alone)
    monkeypatch.setattr(liveness, "numbered", lambda rows, product: rows.withColumn("component_id", F.col("component")))


def test_an_earlier_entry_may_claim_what_another_entry_is_bound_to(spark):
    """Two entries with one code, symbol and path, the first bound to d2, the second to d1: the first claims a finding about d1, since no record of its own entry is bound to d1."""
    found = spark.createDataFrame([("DS1001", "d1", "p", 1, 1, "r", None, False), ("DS1401", "f", "p", 9, 1, "f(x)", "f", False), ("DS1602", "", "q", 1, 1, "q", None, False)], "code string, declaration string, path string, line int, col int, ref string, holder string, withheld boolean")
    records = [(1, "DS1001", "r", "p", "d2", "ignore", "a"), (2, "DS1001", "r", "p", "d1", "ignore", "b"), (3, "DS1401", "f", "p", "f", "ignore", "c"), (4, "DS1602", "q", "q", "", "inline", "d"), (5, "DS1001", "r", "p", "d3", "ignore", "e")]
    table = spark.createDataFrame(records, "record_ord long, code string, symbol string, path string, bound string, mechanism string, site string")
    holds = spark.createDataFrame([("d3",)], "id string")
    assert pairs(rules.ledger(found, table, [], holds).collect(), "record_ord", "verdict") == {(1, "in-effect"), (2, "stale"), (3, "in-effect"), (4, "stale"), (5, "dormant")}


def test_marks_keep_what_a_record_is_bound_to(spark, light):
    facts = project(spark)
    one = spark.createDataFrame([(1, "DS1002", "ts://f.ts#pal", "f.ts", "pal", "ignore", "s")], "record_ord long, code string, symbol string, path string, bound string, mechanism string, site string")
    got = analysis.analyze(facts | {"suppressions": one})
    # pal stays, so dead, which it uses, is used; the record is in effect against the run without it.
    left = {r.declaration: (r.code, r.message) for r in got.findings.where("not withheld").collect()}
    assert not {"pal", "dead"} & left.keys() and [r.verdict for r in got.verdicts.collect()] == ["in-effect"]
    assert left["onlytest"] == ("DS1102", "function onlytest is referenced only from test files and never from production code")


def test_sentences(spark):
    from quietus.functions import refs

    kind = "code string, kind string, name string, exported boolean, visibility string, relation string, production long, test long, evidence long, writes long, holder string"
    rows = [
        ("DS1001", "function", "f", True, "public", "reference-counting", 0, 0, 0, 0, None, "exported function f has no reference in the target and none from any loaded consumer"),
        ("DS1002", "type", "T", False, "public", "reachability", 1, 0, 0, 0, None, "unexported type alias T is referenced only from declarations that are themselves dead"),
        ("DS1003", "method", "m", False, "private", "reference-counting", 0, 0, 0, 0, None, "private method m has no reference in the target"),
        ("DS1102", "class", "C", True, "public", "reachability", 1, 1, 0, 0, None, "class C is referenced only from test files and from declarations that are themselves dead"),
        ("DS1102", "class", "C", True, "public", "reference-counting", 0, 2, 2, 0, None, "class C is referenced from no file and kept only by evidence in test files"),
        ("DS1104", "function", "f", True, "public", "reference-counting", 0, 1, 0, 0, None, "deprecated function f has no production reference"),
        ("DS1201", "interface", "I", True, "public", "reference-counting", 0, 0, 0, 0, None, "nothing in the target names interface I as a type"),
        ("DS1301", "class-member", "x", False, "protected", "reference-counting", 0, 0, 0, 3, None, "protected class member x is written at 3 positions and never read"),
        ("DS1401", "function", "p", False, "public", "reference-counting", 0, 0, 0, 0, "f", "parameter p of f is never read in the body"),
        ("DS1503", "function", "f", True, "public", "reference-counting", 1, 0, 0, 0, None, "exported function f is referenced only inside the file that declares it"),
        ("DS7777", "function", "f", True, "public", "reference-counting", 1, 0, 0, 0, None, None),
    ]
    got = spark.createDataFrame(rows, kind + ", want string").withColumn("said", refs.message(*[c.split()[0] for c in kind.split(", ")]))
    assert [(r.said, r.want) for r in got.collect() if r.said != r.want] == []


def test_entries_fall_back_to_the_holder_of_parts_only(spark):
    from quietus.functions import refs
    from quietus.operators import evidence

    symbols = spark.createDataFrame([("d", "ts://a#f", "a")], "id string, ref string, path string")
    entries = spark.createDataFrame([("part", "DS1401", "ts://a#f(x)", "a"), ("other", "DS1001", "ts://a#f(x)", "a"), ("own", "DS1001", "ts://a#f", "a")], "entry string, code string, ref string, path string")
    assert pairs(evidence.bound_symbols(entries, symbols, refs.parameter_holder("ref")).collect(), "entry", "bound", "by_holder") == {("part", "d", True), ("own", "d", False)}


def test_members_own_what_is_written_in_them(spark):
    from quietus.operators import carriers

    symbols = spark.createDataFrame([("g", "file", "", True), ("c", "class", "g", True), ("x", "class", "g", False), ("y", "class", "g", False), ("main", "function", "g", False), ("o", "class", "g", False), ("oo", "method", "o", False), ("z", "class", "g", False)], "id string, kind string, parent string, exported boolean")
    ref = "ref_ord long, from_id string, to_id string, use string, test boolean, guessed boolean, namespace boolean, reexport boolean, consumer string, line int, col int"
    row = lambda k, a, b, line, col, use="read", test=False: (k, a, b, use, test, False, True, False, "", line, col)
    refs_ = spark.createDataFrame([row(1, "main", "c", 1, 1), row(2, "c", "x", 12, 5), row(3, "c", "y", 12, 40), row(4, "main", "o", 1, 1), row(5, "oo", "z", 3, 1), row(6, "main", "z", 2, 2, test=True), row(7, "main", "z", 2, 3, "write")], ref)
    members = spark.createDataFrame([("c.outer", "c", 10, 1, 20, 1), ("c.inner", "c", 12, 3, 12, 9)], "key string, within string, from_line int, from_col int, to_line int, to_col int")
    ids = lambda *x, kind="id string": spark.createDataFrame([i if isinstance(i, tuple) else (i,) for i in x], kind)
    none = ids(kind="id string, child string")
    run = lambda reads: pairs(carriers.carry(symbols, refs_, none, ids("main"), members, ids("o"), ids(kind="from_id string, to_id string"), ids(*reads, kind="from_id string, member string")).collect(), "id", "member")
    # What is written in a member is followed once the member is read; an opaque class and its methods are sealed.
    assert run([]) == {("main", False), ("c", False), ("o", False)}
    assert run([("main", "c.inner")]) == {("main", False), ("c", False), ("o", False), ("c.inner", True), ("x", False)}
    assert run([("main", "c.outer"), ("x", "c.inner")]) == {("main", False), ("c", False), ("o", False), ("c.outer", True), ("y", False)}


def test_peers_are_looked_for_above_only(spark):
    from quietus.operators import carriers

    declared = spark.createDataFrame([("", "react"), ("a", "react"), ("a/b", "ui"), ("a/b/c", "react"), ("", "dom"), ("z", "dom")], "dir string, name string")
    peers = spark.createDataFrame([("a/b", "ui", "react"), ("a", "react", "dom"), ("z", "dom", "react")], "dir string, name string, peer string")
    needed = spark.createDataFrame([("a/b", "ui"), ("q", "ui")], "dir string, name string")
    assert pairs(carriers.needed_with_peers(declared, peers, needed).collect(), "dir", "name") == {("a/b", "ui"), ("", "react"), ("a", "react"), ("", "dom")}



def test_a_new_reference_never_makes_code_dead(spark):
    facts = project(spark)
    before = pairs(liveness.judge(*[facts[n] for n in ("symbols", "references", "roots", "held_seeds", "exempt")]).where("dead").collect(), "id")
    more = facts["references"].unionByName(facts["references"].where("from_id = 'main'").withColumn("to_id", F.lit("pal")))
    after = pairs(liveness.judge(facts["symbols"], more, facts["roots"], facts["held_seeds"], facts["exempt"]).where("dead").collect(), "id")
    assert after < before and ("dead",) not in after


def test_support_is_what_only_tests_reach(spark):
    uses = spark.createDataFrame([("t.ts", "help.ts"), ("help.ts", "deep.ts"), ("t.ts", "shared.ts"), ("main.ts", "shared.ts"), ("t.ts", "rooted.ts"), ("shared.ts", "below.ts")], "from_path string, to_path string")
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = support_files(uses, one("t.ts"), one("rooted.ts"))
    assert pairs(got.collect(), "path") == {("help.ts",), ("deep.ts",)}
    split = support_files(uses, one("t.ts"), one("rooted.ts"), one("deep.ts"))
    assert pairs(split.collect(), "path", "support") == {("help.ts", False), ("deep.ts", False)}


def test_tests_of_dead_code(spark):
    link = spark.createDataFrame([("t1", "d"), ("t1", "s"), ("t2", "d"), ("t2", "l"), ("t3", "d"), ("t3", "s2"), ("t2", "s2")], "from_id string, to_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = liveness.tests_of_dead_code(link, ids("t1", "t2", "t3", "s", "s2"), ids("s", "s2"), ids("d"), ids("d", "l"))
    assert pairs(got.collect(), "id") == {("t1",)}


def test_ledger_claims_in_reading_order(spark):
    found = spark.createDataFrame([("DS1001", "d1", "p", 1, 1, "r", False), ("DS1001", "d2", "p", 5, 1, "r", True)], "code string, declaration string, path string, line int, col int, ref string, withheld boolean")
    records = spark.createDataFrame([(1, "DS1001", "r", "p", "d1"), (2, "DS1001", "r", "p", "d1"), (3, "DS1001", "r", "p", "d2"), (4, "DS1002", "r", "p", "d9")], "record_ord long, code string, symbol string, path string, bound string")
    assert pairs(rules.ledger(found, records, ["DS1002"]).collect(), "record_ord", "verdict") == {(1, "in-effect"), (2, "stale"), (3, "dormant"), (4, "dormant")}


def test_line_union_and_intervals(spark):
    rows = spark.createDataFrame([("g", "p", 1, 5), ("g", "p", 3, 8), ("g", "p", 20, 20), ("g", "q", 9, 7)], "g string, path string, line int, end_line int")
    assert joins.gap_and_island_lines(rows, ["g"]).first()["lines"] == 8 + 1 + 1
    spans = spark.createDataFrame([("p", 1, 300, "outer"), ("p", 50, 60, "inner")], "path string, from_line int, to_line int, id string")
    points = spark.createDataFrame([("p", 55, "a"), ("p", 200, "b"), ("p", 301, "c")], "path string, line int, point string")
    assert pairs(joins.innermost_interval(points, spans).collect(), "point", "id") == {("a", "inner"), ("b", "outer")}


def test_exemptions(spark):
    records = spark.createDataFrame([(1, "a", "enum-group", None, False, ["m"]), (2, "b", "enum-group", None, False, []), (3, "c", "decorator", "x", True, []), (4, "d", "decorator", "dead", False, [])], "exempt_ord long, id string, class string, while_live string, while_written boolean, methods array<string>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert pairs(exemptions.settled(records, ids("other"), ids("c"), ids("x")).collect(), "id") == {("b",), ("c",)}


def test_versions():
    yes = [("1.2.3", "^1.2.0"), ("1.2.3", "1.x"), ("0.2.9", "^0.2.3"), ("1.2.3", "1.0.0 - 1.3"), ("2.0.0", "<1 || >=2"), ("1.2.3-beta.2", ">=1.2.3-beta.1"), ("1.5.0", "*"), ("1.2.4", "~1.2.3"), ("3.0.0", ">2"), ("1.2.9", "<=1.2")]
    no = [("2.0.0", "^1.2.0"), ("0.3.0", "^0.2.3"), ("1.4.0", "1.0.0 - 1.3"), ("1.3.0-beta", "^1.2.0"), ("1.2.3-alpha", ">=1.2.3"), ("2.9.0", ">2"), ("1.3.0", "~1.2.3"), ("2.0.0-rc.1", "^1.0.0")]
    assert all(semver.satisfies(*c) for c in yes) and not any(semver.satisfies(*c) for c in no)
    assert semver.satisfies("x", "*") is None and semver.satisfies("1.0.0", "^^1") is None


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(globs.glob_regex(g), p))
    assert hit("src/**/*.ts", "src/a.ts") and hit("src/**/*.ts", "src/a/b/c.ts") and not hit("src/*.ts", "src/a/b.ts") and hit("{a,b{c,d}}.ts", "bd.ts") and hit("[!a]x", "bx") and not hit("[!a]x", "ax") and hit("**", "a/b")
    with pytest.raises(globs.PatternError):
        globs.glob_regex("{a,b}" * 9)
    assert globs.ref_like("a*b?_%") == r"a%b_\_\%"


def test_paths(spark):
    row = lambda column, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(column.alias("r")).first()["r"]
    for given, want in [("a/./b//c/../d", "a/b/d"), ("../../x", "../../x"), ("/../x", "/x"), ("a/..", "."), ("", "."), ("a/../../b", "../b")]:
        assert row(paths.normalized("p"), p=given) == want
    assert row(paths.relative_to("p", "b"), p="a/b/c", b="a/x/y") == "../../b/c" and row(paths.relative_to("p", "b"), p="a", b="a") == "."
    assert [row(paths.package_of("p"), p=s) for s in ("@s/n/x", "lodash/fp", "./a", "node:fs", "/abs", "#in")] == ["@s/n", "lodash", None, None, None, None]
    assert row(paths.ancestors("p"), p="a/b") == ["a/b", "a", ""] and row(paths.extension("p"), p="x.d.ts") == ".d.ts" and row(paths.dirname("p"), p="a/b/c") == "a/b"


def test_text_functions(spark):
    assert text.shell_words("a 'b c' \"d$X\" && e \\ f # no\n g") == [["a", "b c"], ["e", " f"], ["g"]]
    assert text.yaml_value("a:\n  - x: 1\n    y: 'it''s'\n  - z\nb: {c: [d, 2]}\ne: # none\n") == {"a": [{"x": 1, "y": "it's"}, "z"], "b": {"c": ["d", 2]}, "e": None}
    for bad in ("a: 1\na: 2", "a: &x 1", "a:\n    b: 1\n  c: 2"):
        with pytest.raises(ValueError):
            text.yaml_value(bad)
    assert text.html_entries("<script src=a.js></script><link rel='modulepreload' href=b.js><script>x</script>") == ["a.js", "b.js"]
    for bad in ('{"a":1,"a":2}', "[NaN]", "[" * 80 + "]" * 80, "{"):
        with pytest.raises(text.StrictJSONError):
            text.strict_json(bad)
    assert text.json_strings('{"a":["x",{"b":"y"}],"c":3}') == ["x", "y"] and text.json_strings("no") is None
    hashes = text.line_hashes("a b\nsame\n\nsame")
    assert len(hashes) == 4 and len({h.split(":")[0] for h in hashes}) >= 3 and text.line_hashes("ab")[0] == text.line_hashes("a b")[0] and text.line_hashes("x\nx")[0] != text.line_hashes("x\nx")[1]


def test_templates():
    run = lambda t, d: template.render(template.parse(t), d)
    assert run('{{range $k, $v := .m}}{{$k}}={{$v}};{{end}}{{if and .a (not .b)}}yes{{else}}no{{end}}{{/* c */}} {{- printf "%d-%s" 3 "x"}}', {"m": {"b": 2, "a": 1}, "a": 1, "b": 0}) == "a=1;b=2;yes3-x"
    lists = {"l": ["a", "b"], "e": [], "n": None, "f": [{"l": 4}, {"l": 10}]}
    assert run("{{$n := 0}}{{range .f}}{{$n = .l}}{{end}}{{$n}}", lists) == "10" and run("{{.n}}|{{.l}}", lists) == "<no value>|[a b]"
    assert run("{{$x := 0}}{{range $x = .l}}{{$x}}{{end}}{{$x}}", lists) == "abb" and run("{{$i := 9}}{{$x := 0}}{{range $i, $x = .l}}{{end}}{{$i}}{{$x}}", lists) == "1b"
    assert run("{{$x := 0}}{{range $x = .e}}{{end}}{{$x}}", lists) == "[]" and run("{{range .l}}{{if eq . \"b\"}}{{break}}{{end}}{{.}}{{end}}", lists) == "a" and run("{{range .l}}{{if eq . \"a\"}}{{continue}}{{end}}{{.}}{{end}}", lists) == "b"
    for bad in ("{{$x = 1}}", "{{if 1}}{{$x := 1}}{{end}}{{$x}}", "{{break}}", "{{.missing}}", '{{eq 1 "1"}}'):
        with pytest.raises(template.TemplateError):
            run(bad, lists)
    for bad in ("{{if .a}}", "{{nope .a}}", "{{end}}", "{{.a"):
        with pytest.raises(template.TemplateError):
            run(bad, {})


def test_schema_refusals():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"$ref": "#/d"}}}, "d": {"type": "integer", "minimum": 0}}
    assert schema.refusals({"a": [1, 2]}, s) == [] and schema.refusals({"a": [-1, "x"], "z": 1}, s) == ["/a/0: out of range", "/a/1: not of type integer", "/z: nothing is allowed here"] and schema.refusals({}, s) == [": a is missing"]


def test_sources(spark, tmp_path):
    for name, content in {"src/a.ts": "x\ny", "src/gen.ts": "// @generated\n", "node_modules/p/i.ts": "z", "package.json": '{"name":"n","main":"./m.ts","scripts":{"b":"tsc src/a.ts"},"dependencies":{"tsc":"*"}}', ".ignore": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    files = tree.files_below(spark, str(tmp_path))
    assert {r.path for r in files.collect()} >= {"src/a.ts", "src/gen.ts", "package.json"} and not files.where("path like '%node_modules%'").count()
    assert pairs(tree.source_files(files).collect(), "path", "end_line") == {("src/a.ts", 2), ("src/gen.ts", 2)}
    docs = tree.documents(files, most=60)
    assert {r.path: r.refusal for r in docs.collect()}["package.json"] == "over the size bound"
    read = manifests.manifests(tree.documents(files))
    assert read.first()["state"] == "read" and pairs(manifests.entry_points(read).collect(), "target") == {("m.ts",)}
    words = manifests.commands(read)
    assert pairs(manifests.words_to_files(words, files).collect(), "path") == {("src/a.ts",)} and pairs(manifests.words_to_packages(words, manifests.declared(read)).collect(), "name") == {("tsc",)}
    assert pairs(tree.documents(files).where(tree.generated()).collect(), "path") == {("src/gen.ts",)}
    got = tree.ignored(files, ["src/*", "!src/a.ts", "*.json"])
    assert {r.path for r in got.where("ignored").collect()} >= {"src/gen.ts", "package.json"} and not got.where("path = 'src/a.ts' and ignored").count()


def test_suppression_and_edge_documents(spark):
    doc = spark.createDataFrame([('{"ignore":[{"code":"DS1001","symbol":"s","path":"p","reason":"r"},{"code":"DS1001","symbol":"s","path":"p"},{"code":"DS1001","reason":"r"}]}',)], "text string")
    assert pairs(manifests.suppressions(doc, "ignore").collect(), "record_ord", "refusal") == {(0, None), (1, "DS9001"), (2, "DS9002")}
    side = spark.createDataFrame([('{"edges":{"e1":{"provides":["a"],"used_by":["b","c"]}}}',)], "text string")
    assert pairs(manifests.edge_sides(side).collect(), "edge", "side", "symbol") == {("e1", "provides", "a"), ("e1", "used_by", "b"), ("e1", "used_by", "c")}
    lines = spark.createDataFrame([("p", 1, "// quietus-ignore DS1001, DS1002: kept for now"), ("p", 5, "// quietus-ignore DS1001"), ("p", 9, "// quietus-ignore everything"), ("p", 3, "let x")], "path string, line int, text string")
    found = manifests.inline_directives(lines)
    assert pairs(found.collect(), "line", "state") == {(1, "ok"), (5, "no-reason"), (9, "malformed")}
    at = spark.createDataFrame([("p", 2, "sym"), ("p", 2, "sym")], "path string, line int, id string")
    assert pairs(manifests.bound_directives(found, at).collect(), "code", "symbol") == {("DS1001", "sym"), ("DS1002", "sym")}
    flow = spark.createDataFrame([("ci.yml", "jobs:\n  build:\n    steps:\n      - run: npm test\n      - uses: x\n"), ("bad", "a: &x")], "path string, text string")
    assert pairs(manifests.workflow_commands(flow).collect(), "line") == {("npm test",)}
    mdx = spark.createDataFrame([("d.mdx", "import A from './a'\nimport './b'\n# text from 'c'")], "path string, text string")
    assert pairs(manifests.document_imports(mdx).collect(), "specifier") == {("./a",), ("./b",)}
    assert manifests.resolved([{"severity": {"A": "deny"}, "x": None}, {"severity": {"B": "warn"}, "x": 3}]) == {"severity": ({"B": "warn", "A": "deny"}, 0), "x": (3, 1)}


def test_counts_and_modes(spark):
    facts = project(spark)
    got = {r.id: (r.production, r.test) for r in edges.reference_counts(facts["references"], facts["symbols"]).collect()}
    assert got["onlytest"] == (0, 1) and got["used"] == (1, 0)


ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["reference_counts", "merge_references", "reach_levels", "dead_symbols", "ledger_verdicts", "report_totals", "nearest_ancestor", "ignored_paths"])
def test_queries_match_their_sql(spark, name):
    import os

    import __spark_entry__

    if not os.path.isdir(ROOT):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for file in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{ROOT}/{file}'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, ROOT).toPandas()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_sarif_log_holds_every_finding(spark, monkeypatch):
    row = "path string, line int, col int, code string, ref string, severity string, lines long, subject_lines long, withheld boolean"
    found = spark.createDataFrame([(f"p{k % 7}", k, 1, "DS1001", f"r{k}", "deny", k, k, k % 5 == 0) for k in range(3000)], row)
    monkeypatch.setattr(queries, "_found", lambda spark, sf: found)
    want = sorted(f"r{k}" for k in range(3000) if k % 5)
    for piece in (10_000, 500):
        monkeypatch.setattr(queries, "SARIF_PIECE", piece)
        logs = [json.loads(r["sarif"]) for r in queries.sarif_log(spark, "").collect()]
        assert len(logs) == -(-2400 // piece) and sorted(x["message"]["text"] for log in logs for x in log["runs"][0]["results"]) == want
    monkeypatch.setattr(queries, "_found", lambda spark, sf: found.where("false"))
    assert [json.loads(r["sarif"])["runs"][0]["results"] for r in queries.sarif_log(spark, "").collect()] == [[]]


def test_fixpoints_cut_short_raise(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    assert reach(chain, seeds, "src", "dst").count() == 7
    loop = chain.unionByName(spark.createDataFrame([("n6", "n0")], "src string, dst string"))
    steps = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "direct", False, False, True) for k in range(6)], EDGE)
    start = spark.createDataFrame([("n0", False, True)], "node string, holds boolean, passes boolean")
    none = spark.createDataFrame([], "id string, child string")
    uses = chain.select(F.col("src").alias("from_path"), F.col("dst").alias("to_path")).unionByName(spark.createDataFrame([("t", f"n{k}") for k in range(7)] + [("x", "n0")], "from_path string, to_path string"))
    tests, rooted = spark.createDataFrame([("t",)], "path string"), spark.createDataFrame([], "path string")
    for short in (lambda: reach(chain, seeds, "src", "dst", max_rounds=3), lambda: strong_components(loop, max_rounds=2), lambda: walk(steps, start, none, max_rounds=3), lambda: support_files(uses, tests, rooted, max_rounds=2)):
        with pytest.raises(RuntimeError, match="max_rounds"):
            short().collect()


def test_first_claims_are_those_of_all_pairs_without_listing_them(spark, monkeypatch):
    draw = random.Random(3)
    some = lambda *x: draw.choice(x)
    found = [(f"f{k}", some("DS1001", "DS1401", "DS1602", "DS9003"), some("", "d1", "d2", "d3"), some("r", "q"), some("h", None), "p") for k in range(120)]
    said = [(k, some("DS1001", "DS1401", "DS1602", "DS9003"), some("r", "q", "h"), some("p", "o"), some("", "d1", "d2", "d3"), some("inline", "ignore", "baseline"), some("a", "b", "c", "d")) for k in range(150)]
    findings = spark.createDataFrame(found, "finding string, code string, declaration string, ref string, holder string, path string")
    records = spark.createDataFrame(said, "record_ord long, code string, symbol string, path string, bound string, mechanism string, site string")
    want = {(r.finding, r.m) for r in selfcheck.named(findings, records).groupBy("finding").agg(F.min("record_ord").alias("m")).collect()}
    placed = findings.withColumns({"line": F.lit(1), "col": F.expr("int(substr(finding, 2)) % 40"), "withheld": F.lit(False)})
    at = {f"f{k}": (row[1], k % 40) for k, row in enumerate(found)}
    owner = {}
    for f, m in want:
        owner[at[f]] = min(m, owner.get(at[f], m))
    monkeypatch.setattr(selfcheck, "named", None)  # pairs grow with the square of what shares a reference
    assert {(r.finding, r.record_ord) for r in selfcheck.claimed(findings, records).collect()} == want and len(want) > 50
    assert {(r.finding, r.record_ord) for r in rules.claims(placed, records).collect()} == {(f, m) for f, m in want if owner[at[f]] == m}


def test_edges_are_joined_once_for_both_sides_of_a_walk(spark):
    symbols = spark.createDataFrame([("f", "file", "", False), ("a", "class", "f", True), ("b", "class", "f", False)], "id string, kind string, parent string, exported boolean")
    refs = spark.createDataFrame([("a", "b"), ("a", "gone"), ("gone", "b"), ("gone", "f"), ("x", "gone")], "from_id string, to_id string").selectExpr("*", "'read' as use", "false as test", "false as guessed", "true as namespace", "true as reexport", "if(from_id = 'x', 'shop', '') as consumer")
    inner, outer = steps_of(edges.graph_edges(refs, symbols), liveness.exports_of(symbols))
    assert "Join" not in inner._jdf.queryExecution().optimizedPlan().toString() + outer._jdf.queryExecution().optimizedPlan().toString()
    # What is no declaration is not reached, and opens no gate.
    seeds, none = spark.createDataFrame([("a", "configured")], "id string, kind string"), symbols.select("id").limit(0)
    gates = spark.createDataFrame([("gone", "b"), ("f", "a")], "file string, id string")
    alone = refs.where("from_id <> 'gone' and to_id <> 'b'")
    assert pairs(liveness.sweep_reach(symbols, alone, seeds, none, gates).collect(), "node") == {("a",)}
    assert pairs(liveness.sweep_reach(symbols, refs, seeds, none, gates).collect(), "node") == {("a",), ("b",), ("f",)}


def test_weak_components_hold_no_uncompressed_rounds(spark, monkeypatch):
    from quietus.graph import components

    monkeypatch.setattr(components, "cut", None)
    got = components.weak_components(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (1, 2)], "src long, dst long"))
    assert pairs(got.collect(), "node", "root") == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_members_own_places_without_an_order_of_all_references(spark):
    refs = spark.createDataFrame([("a", "t1", 3, 1), ("a", "t2", 3, 1), ("a", "t3", 4, 1), ("b", "t1", 3, 1), ("a", "t4", 70, 2)], "from_id string, to_id string, line int, col int")
    members = spark.createDataFrame([("wide", "a", 2, 1, 70, 1), ("slim", "a", 3, 1, 3, 9)], "key string, within string, from_line int, from_col int, to_line int, to_col int")
    numbered = refs.selectExpr("row_number() OVER (ORDER BY from_id, to_id) AS ref_ord", "*")
    own = carriers.owned_by_members(numbered, members)
    assert pairs(own.collect(), "from_id", "to_id") == {("slim", "t1"), ("slim", "t2"), ("wide", "t3"), ("b", "t1"), ("a", "t4")}
    assert "Window" not in own.drop("ref_ord")._jdf.queryExecution().optimizedPlan().toString()
