"""The library's entry points: ``analyze`` from facts to findings, ``explain`` for one subject, listings, and renderings to files.

Facts are DataFrames by name (see ``facts.adapters`` for their columns). Registries of emitters and renderings are open: a caller may add its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietus.functions import template as templates
from quietus.functions.schema import refusals
from quietus.functions import refs as messages
from quietus.functions.refs import parameter_holder as refs_of_parts
from quietus.graph.edges import graph_edges, visibility_reach, write_only
from quietus.graph.maintain import Maintained
from quietus.operators import codes, evidence, liveness, rules, selfcheck, surface
from quietus.session import cut, ship


@dataclass
class Config:
    production: bool = True
    guessed: bool = False
    roots_complete: bool = False
    least: str = "possible"
    fail_on: str = "deny"
    severity: dict[str, str] = field(default_factory=dict)
    most: int = 0
    sort: str = "position"
    product: str = "ts"
    #: All consumers are loaded; the manifest closes the package's files off; the listed projects are all there are.
    closed: bool = False
    encapsulated: bool = False
    complete_matrix: bool = False


@dataclass
class Analysis:
    judged: DataFrame
    reached: DataFrame
    components: DataFrame
    findings: DataFrame
    verdicts: DataFrame | None
    stale: DataFrame
    exit_code: int


#: Facts (id) that flag a declaration, and the flag.
FLAG_FACTS = {"deprecated": "deprecated", "tests_of_dead": "test_of_dead", "test_code": "in_test", "unreferenced_tests": "unreferenced_test", "held_by_tests": "held_by_itself", "kept_by_tests": "kept_by_tests", "brands": "brand", "markers": "marker"}


def _flagged(rows: DataFrame, table: DataFrame | None, name: str) -> DataFrame:
    if table is None:
        return rows.withColumn(name, F.lit(False))
    return rows.join(table.select("id", F.lit(True).alias(name)).distinct(), "id", "left").na.fill(False, [name])


def _dead(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame:
    inside = judged.where("dead").select(F.col("id").alias("parent"), F.lit(True).alias("container_dead"))
    rows = judged.where("dead").join(inside, "parent", "left").join(judged.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind")), "parent", "left").na.fill("", ["parent_kind"])
    for name, flag in FLAG_FACTS.items():
        rows = _flagged(rows, facts.get(name), flag)
    rows = _flagged(rows, facts["roots"], "rooted").withColumn("encapsulated", F.lit(config.encapsulated))
    return codes.with_flags(rows).withColumn("code", codes.code_of_dead()).where("code is not null").select("code", "id", "relation")


def _narrowed(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame:
    symbols = facts["symbols"]
    live = judged.where("not dead and kind <> 'file'").select("id", "kind", "path", "parent", "exported").join(visibility_reach(facts["references"], symbols), "id").join(codes.entered(symbols, facts["roots"]), "id")
    live = live.join(symbols.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind")), "parent")
    live = _flagged(live, write_only(facts["references"], facts["exempt"]), "written")
    live = _flagged(live, facts.get("exposed"), "exposed")
    return live.withColumn("code", codes.code_of_live(config.closed)).where("code is not null").select("code", "id", F.lit("reference-counting").alias("relation"))


def _written(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame:
    rows = write_only(facts["references"], facts["exempt"]).join(judged.where("dead").select("id"), "id", "left_anti")
    return rows.select(F.lit("DS1301").alias("code"), "id", F.lit("reference-counting").alias("relation"))


def _files(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame:
    from quietus.graph.walk import reach

    at = judged.select("path", "id", "kind")
    starts = facts["roots"].join(judged.select("id", "path"), "id").select(F.col("path").alias("node")).distinct()
    used = facts["references"].select(F.col("path").alias("from_path"), F.col("to_id").alias("id")).join(judged.select("id", F.col("path").alias("to_path")), "id").where("from_path <> to_path").select("from_path", "to_path").distinct()
    kept = reach(used, starts, "from_path", "to_path").select(F.col("node").alias("path"))
    return at.where("kind = 'file'").join(kept, "path", "left_anti").select(F.lit("DS1602").alias("code"), "id", F.lit("reachability").alias("relation"))


def _own(rows: DataFrame, code: str | None = None) -> DataFrame:
    """Findings about rows of documents, or parts: path, line and ref are theirs, and ``id`` names the declaration that holds the part, or is empty."""
    rows = rows if code is None else rows.withColumn("code", F.lit(code))
    have = rows.columns
    text = lambda c, other: (F.col(c) if c in have else F.lit(other)).cast("string").alias(c)
    return rows.select("code", text("id", ""), F.lit("reference-counting").alias("relation"), text("path", ""), (F.col("line") if "line" in have else F.lit(1)).cast("int").alias("line"), text("ref", ""), text("confidence", "certain"))


def _parts(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame | None:
    if "parts" not in facts:
        return None
    none = facts["symbols"].select("id").limit(0)
    calls = facts.get("calls")
    found = codes.part_findings(facts["parts"], facts["signatures"], facts["roots"].select("id"), facts.get("callers_unknown", none), codes.discarded_everywhere(calls) if calls is not None else none)
    at = facts["symbols"].select(F.col("id").alias("declaration"), "path", "line", F.col("name").alias("holder"))
    rows = found.join(at, "declaration").join(judged.where("not dead").select(F.col("id").alias("declaration")), "declaration", "left_semi")
    return _own(rows.withColumns({"id": F.col("declaration"), "ref": F.concat(F.lit("ts://"), "path", F.lit("#"), "holder", F.lit("("), "name", F.lit(")"))}))


def _imports(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame | None:
    if "imports" not in facts:
        return None
    unused = rules.unused_imports(facts["imports"])
    at = facts["imports"].groupBy("declaration", "name").agg(F.min("path").alias("path"), F.min("line").alias("line"))
    return _own(unused.join(at, ["declaration", "name"]).withColumn("ref", F.concat(F.lit("ts://"), "path", F.lit("#"), "name")), "DS1004")


def _dependencies(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame | None:
    if "dependencies" not in facts:
        return None
    ran = facts["ran"] if "ran" in facts else facts["dependencies"].select("name").limit(0)
    rows = rules.unused_dependencies(facts["dependencies"].select("dir", "name"), facts["needs"], ran, judged.where("dead").select("id"))
    manifest = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit("package.json"))
    return _own(rows.withColumns({"path": manifest, "ref": F.concat(F.lit("ts://"), manifest, F.lit("#"), "name")}), "DS1701")


def _self_check(facts: dict[str, DataFrame], judged: DataFrame, config: Config) -> DataFrame | None:
    rows = []
    if "written_records" in facts:
        at = facts["written_records"].select("record_ord", F.coalesce("site_path", F.lit("")).alias("path"), F.col("symbol").alias("ref"))
        rows.append(_own(selfcheck.refused(facts["written_records"]).join(at, "record_ord")))
    for asked, matched, code in (("asked_roots", "matched_roots", "DS9004"), ("asked_declarations", "matched_declarations", "DS9006")):
        if asked in facts:
            rows.append(_own(selfcheck.unmatched_everywhere(facts[asked], facts[matched]).withColumn("ref", F.col("source")), code))
    if "tree" in facts:
        never = selfcheck.never_built(facts["tree"], facts["symbols"].where("kind = 'file'"), config.complete_matrix)
        rows.append(_own(never.withColumn("ref", F.concat(F.lit("ts://"), "path")), "DS1601"))
    return reduce(DataFrame.unionByName, rows) if rows else None


#: name -> (facts, judged, config) -> (code, id, relation), and path, line, ref, confidence where the finding is about no declaration; or None.
EMITTERS: dict[str, Callable[[dict[str, DataFrame], DataFrame, Config], DataFrame | None]] = {
    "dead": _dead, "narrowing": _narrowed, "writes": _written, "files": _files, "parts": _parts, "imports": _imports, "dependencies": _dependencies, "self_check": _self_check,
}


def _seeded(facts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(held, exempt, gates): the seeds and exemptions of the facts, those of exemption records among them: what their declarations use stays."""
    held, exempt, gates = facts["held_seeds"].select("id"), facts["exempt"].select("id"), facts.get("gates")
    if "records" in facts:
        unanswered = facts["unanswered"] if "unanswered" in facts else held.limit(0)
        seeds = cut(liveness.seeds_of(facts["records"], facts["symbols"], unanswered))
        own = seeds.where("tier <> 'gated'").select("id")
        held, exempt = held.unionByName(own).distinct(), exempt.unionByName(own).distinct()
        more = seeds.where("tier = 'gated'").select("file", "id")
        gates = more if gates is None else gates.select("file", "id").unionByName(more).distinct()
    return held, exempt, gates


def _derived(facts: dict[str, DataFrame], judged: DataFrame, reached: DataFrame) -> dict[str, DataFrame]:
    """``facts`` with those that others give: tests of dead code and what tests keep (from test_code and support), exposed types (from carriers and outside), what tests use (from test_seeds)."""
    facts, dead = dict(facts), judged.where("dead").select("id")
    edges = facts["references"].select("from_id", "to_id", "test")
    if "test_code" in facts and "support" in facts:
        code = facts["test_code"].select("id").unionByName(facts["support"].select("id")).distinct()
        if "tests_of_dead" not in facts:
            facts["tests_of_dead"] = cut(liveness.tests_of_dead_code(edges.select("from_id", "to_id"), code, facts["support"].select("id"), dead, judged.where("kind <> 'file'").select("id")))
        if "kept_by_tests" not in facts:
            met = facts["test_code"].select("id").join(reached.select(F.col("node").alias("id")), "id", "left_semi")
            facts["kept_by_tests"] = liveness.kept_by_tests(edges, met, facts["tests_of_dead"])
    if "exposed" not in facts and "carriers" in facts and "outside" in facts:
        unread = facts["unread"] if "unread" in facts else dead.limit(0)
        facts["exposed"] = evidence.exposed_types(facts["symbols"], facts["carriers"], facts["outside"], unread)[0]
    if "test_used" not in facts and "test_seeds" in facts:
        facts["test_used"] = liveness.test_used_reach(edges, facts["test_seeds"], dead)
    return facts


@dataclass
class View:
    """What one set of seeds makes of the facts."""

    judged: DataFrame
    components: DataFrame
    rows: DataFrame


def view_of(facts: dict[str, DataFrame], config: Config, reached: DataFrame, exempt: DataFrame, gates: DataFrame | None) -> View:
    """Findings, dialled but not held against records, of declarations judged under ``reached`` (node, level)."""
    symbols, references = facts["symbols"], facts["references"]
    judged = cut(liveness.judge(symbols, references, facts["roots"], facts["held_seeds"], exempt, gates, config.production, reached))
    facts = _derived(facts, judged, reached)
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows for emit in EMITTERS.values() if (rows := emit(facts, judged, config)) is not None])
    for name, kind in (("path", "string"), ("line", "int"), ("ref", "string"), ("confidence", "string")):
        found = found.withColumn(f"own_{name}", F.col(name) if name in found.columns else F.lit(None).cast(kind)).drop(name)
    found = cut(found)
    # A file that nothing imports takes what it holds with it.
    gone = found.where("code = 'DS1602'").select("id")
    components = cut(liveness.numbered(liveness.components_with_files(judged, references, gone), config.product))
    at = judged.select("id", "path", "line", "end_line", "kind", "name", "exported", "production", "test", F.concat(F.lit("ts://"), F.col("path"), F.lit("#"), F.col("name")).alias("ref"))
    used = facts["test_used"].select("id", F.lit(True).alias("test_used")).distinct() if "test_used" in facts else at.select("id", F.lit(False).alias("test_used")).limit(0)
    part = F.col("own_ref").isNotNull()  # what is no declaration of its own falls with none
    rows = found.join(at, "id", "left").join(components.select("id", F.col("component_id").alias("component"), F.col("root").alias("is_root"), "lines"), "id", "left").join(used, "id", "left")
    wrote = write_only(references, exempt).select("id", "writes")
    rows = rows.join(wrote, "id", "left").withColumns({"none": F.lit(0).cast("long"), "reach": F.lit("public"), "part": F.regexp_extract(F.coalesce("own_ref", F.lit("")), r"\(([^()]*)\)$", 1)})
    said = messages.message("code", "kind", F.when(part, F.col("part")).otherwise(F.col("name")), "exported", "reach", "relation", "production", "test", "none", "writes", "name")
    rows = rows.select(
        "code", F.col("id").alias("declaration"), "relation", F.coalesce("own_path", "path").alias("path"), F.coalesce("own_line", "line").alias("line"), F.lit(1).alias("col"), F.coalesce("own_ref", "ref").alias("ref"), F.coalesce("own_confidence", F.lit("certain")).alias("confidence"), F.coalesce("test_used", F.lit(False)).alias("test_used"),
        F.when(part & (F.col("id") != ""), F.col("ref")).alias("holder"), F.coalesce(said, F.coalesce("own_ref", "ref")).alias("message"),
        F.when(part, F.concat(F.lit("own:"), "own_ref")).otherwise(F.coalesce("component", F.concat(F.lit("own:"), F.col("id")))).alias("component"), (part | F.coalesce("is_root", F.lit(True))).alias("is_root"), F.when(part, 0).otherwise(F.coalesce("lines", F.lit(0))).alias("lines"),
        F.when(part, 1).otherwise(F.greatest(F.lit(0), F.col("end_line") - F.col("line")) + 1).alias("subject_lines"),
    )
    if "skipped" in facts:
        rows = codes.outside_skipped(rows, facts["skipped"])
    return View(judged, components, cut(rules.withheld(rules.confidence(rows, config.roots_complete), config.least, config.severity)))


#: Codes whose findings a record's mark can take away: those of a liveness relation. Fixed values.
MARKABLE = ["DS1001", "DS1002", "DS1003", "DS1101", "DS1102", "DS1103", "DS1104", "DS1201", "DS1202", "DS1005", "DS1006", "DS1602", "DS1701"]


def decided(would: View, marked: View, records: DataFrame, config: Config, holds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings under the records, verdicts): a record is held against the findings there would be without any record's mark, where a mark can take them away, else against those under the marks."""
    markable = F.col("code").isin(MARKABLE)
    against = would.rows.where(markable).unionByName(marked.rows.where(~markable))
    taken = cut(rules.claims(against, records))
    verdicts = cut(rules.ledger(against, records, [c for c, s in config.severity.items() if s == "allow"], holds, taken))
    claimed = taken.select(*rules.POSITION, F.lit(True).alias("suppressed")).distinct()
    rows = marked.rows.join(claimed, rules.POSITION, "left").withColumn("withheld", F.col("withheld") | F.coalesce("suppressed", F.lit(False))).drop("suppressed")
    return cut(rows), verdicts


def with_published(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``facts`` with the roots that a library's published files give: all that a consumer can name (published, published_exports, type_uses; optionally type_symbols, tagged, inferred)."""
    if "published" not in facts:
        return facts
    symbols = facts.get("type_symbols", facts["symbols"])
    for name, value in (("visibility", F.lit("public")), ("type_only", F.lit(False)), ("global_block", F.lit(False))):
        if name not in symbols.columns:
            symbols = symbols.withColumn(name, value)
    found = surface.published_api(symbols, facts["type_uses"], facts["published"], facts["published_exports"], facts.get("tagged"), facts.get("inferred"))
    own = facts["published"].select("id").unionByName(found.select("id")).distinct().withColumn("kind", F.lit("published-api"))
    return facts | {"roots": cut(facts["roots"].select("id", "kind").unionByName(own).distinct())}


def analyze(facts: dict[str, DataFrame], config: Config | None = None) -> Analysis:
    """Facts: symbols, references, roots, held_seeds, exempt; optionally gates, unanswered, records (exemptions: id, while_live, unanswered), those of FLAG_FACTS and exposed, test_used or what gives them (see ``_derived``), parts with
    signatures, calls and callers_unknown, imports, dependencies with needs and ran, written_records, asked and matched roots and declarations, tree, skipped, suppressions; published files with
    what they export and the types that declarations write (see ``with_published``).

    Declarations that suppressions are bound to are marked: they stay, and what they use stays. The run is judged once under the marks and once under none.
    """
    config = config or Config()
    ship(facts["symbols"].sparkSession)
    facts = with_published(facts)
    symbols, references = facts["symbols"], facts["references"]
    held, exempt, gates = _seeded(facts)
    reached = cut(liveness.sweep_reach(symbols, references, facts["roots"], held, gates, config.production, config.guessed))
    would = view_of(facts, config, reached, exempt, gates)
    shown, rows, verdicts, stale = would, would.rows, None, would.rows.limit(0).select("code")
    if "suppressions" in facts:
        records = facts["suppressions"]
        marks = cut(records.where("bound <> ''").select(F.col("bound").alias("id")).join(symbols.select("id"), "id", "left_semi").distinct())
        if not marks.isEmpty():
            reached = cut(liveness.sweep_reach(symbols, references, facts["roots"], held.unionByName(marks).distinct(), gates, config.production, config.guessed))
            shown = view_of(facts, config, reached, exempt.unionByName(marks).distinct(), gates)
        rows, verdicts = decided(would, shown, records, config, facts.get("unanswered"))
        stale = cut(rules.stale_sites(verdicts, records))
    published = rules.top(rows.where("not withheld"), config.most, config.sort).drop("place") if config.most else rows
    return Analysis(shown.judged, reached, shown.components, published, verdicts, stale, rules.verdict(rows, stale, config.fail_on))


def baseline_write(facts: dict[str, DataFrame], config: Config | None = None, max_rounds: int = 64) -> DataFrame:
    """(code, ref, path): the rows a baseline settles on, found by repeated analysis from no rows at all.

    A round reads the rows recorded so far: the declarations they are bound to are marked, so what these use stays and its findings go. It records a row for each finding left, and takes out rows that name no finding; a row taken out never returns.
    The walk is kept up from round to round: only the marks that come and go are walked, and their consequences. A member that falls with its container has no finding without marks, so a row for it, which a round under the container's
    mark records, is taken out in the next: such findings stay outside the baseline.
    """
    config = config or Config()
    facts = with_published(facts)
    symbols = facts["symbols"]
    held, exempt, gates = _seeded(facts)
    known = symbols.select(F.col("id").alias("node")).distinct()
    seed = lambda rows, holds: rows.select(F.col("id").alias("node"), F.lit(holds).alias("holds"), F.lit(not holds).alias("passes"))
    seeds = seed(facts["roots"], False).unionByName(seed(held, True)).join(known, "node", "left_semi").distinct()
    walked = Maintained(graph_edges(facts["references"], symbols), seeds, liveness.exports_of(symbols), gates, config.production, config.guessed)
    would = view_of(facts, config, cut(walked.reached()), exempt, gates)
    key = ["code", "ref", "path"]
    named = symbols.select("id", "path", F.concat(F.lit("ts://"), F.col("path"), F.lit("#"), F.col("name")).alias("ref"))
    rows = gone = cut(rules.baseline_rows(would.rows).limit(0))
    marks = cut(named.select("id").limit(0))
    for _ in range(max_rounds):
        bound = evidence.bound_symbols(rows.withColumn("entry", F.struct(*key)), named, refs_of_parts("ref"))
        records = cut(rows.withColumn("entry", F.struct(*key)).join(bound, "entry", "left").select(F.xxhash64(*key, "bound").alias("record_ord"), "code", F.col("ref").alias("symbol"), "path", F.coalesce("bound", F.lit("")).alias("bound"), F.lit("baseline").alias("mechanism"), F.concat_ws("\u0000", *key).alias("site")))
        now = cut(records.where("bound <> ''").select(F.col("bound").alias("id")).distinct().join(held, "id", "left_anti"))
        walked.change(seed(now.join(marks, "id", "left_anti"), True), seed(marks.join(now, "id", "left_anti"), True))
        marks = now
        marked = would if rows.isEmpty() else view_of(facts, config, cut(walked.reached()), exempt.unionByName(marks).distinct(), gates)
        left, verdicts = decided(would, marked, records, config, facts.get("unanswered"))
        live = records.join(verdicts.where("verdict <> 'stale'"), "record_ord", "left_semi").select("code", F.col("symbol").alias("ref"), "path").distinct()
        stale = cut(rows.join(live, key, "left_anti"))
        gone = cut(gone.unionByName(stale).distinct())
        kept = cut(rows.join(stale, key, "left_anti"))
        add = cut(rules.baseline_rows(left).join(gone, key, "left_anti").join(kept, key, "left_anti"))
        if stale.isEmpty() and add.isEmpty():
            return kept
        rows = cut(kept.unionByName(add))
    raise RuntimeError("the baseline did not settle within max_rounds")


def explain(analysis: Analysis, name: str) -> DataFrame:
    """(id, kind, state, relation, component): subjects of that id or name, or the first twenty whose name holds it, and why each is as it is."""
    judged = analysis.judged
    exact = judged.where((F.col("id") == name) | (F.col("name") == name))
    if exact.isEmpty():
        exact = judged.where(F.lower("name").contains(name.lower())).orderBy("name", "id").limit(20)
    rows = exact.join(analysis.components.select("id", F.col("component_id").alias("component")), "id", "left").join(analysis.reached.select(F.col("node").alias("id"), "depth", "holds"), "id", "left")
    state = F.when(F.col("dead"), "dead").when(F.col("depth").isNull(), "kept").when(F.col("holds"), "held").when(F.col("depth") == 0, "root").otherwise("live")
    return rows.select("id", "kind", state.alias("state"), "relation", "component", "depth")


def path_to(facts: dict[str, DataFrame], target: str, production: bool = True) -> list[str]:
    """One shortest chain of declarations from a seed to ``target`` in the first view that reaches it; empty if none does. ``liveness.explained_paths`` gives those of many targets."""
    symbols = facts["symbols"]
    seeds = facts["held_seeds"].select("id", F.lit("record").alias("tier"), F.lit(None).cast("string").alias("file"))
    if "gates" in facts:
        seeds = seeds.unionByName(facts["gates"].select("id", F.lit("gated").alias("tier"), F.col("file").cast("string").alias("file")))
    walked = cut(liveness.tier_walk(symbols, facts["references"], facts["roots"], seeds, production))
    chain = liveness.explained_paths(walked, symbols.where(F.col("id") == target).select("id")).orderBy("place").collect()
    return [r["step"] for r in chain]


REPORT_SCHEMA = {
    "type": "object", "required": ["version", "findings", "totals"], "additionalProperties": False,
    "properties": {
        "version": {"const": 1}, "totals": {"type": "array", "items": {"type": "object", "required": ["code", "findings"]}},
        "findings": {"type": "array", "items": {"type": "object", "required": ["code", "path", "line", "ref", "severity", "confidence"], "properties": {"line": {"type": "integer", "minimum": 1}, "severity": {"enum": rules.SEVERITIES}, "confidence": {"enum": rules.CONFIDENCES}, "code": {"type": "string", "pattern": "^DS[0-9]{4}$"}}}},
    },
}


def report(findings: DataFrame, sort: str = "position") -> DataFrame:
    """One row, ``json``: the published findings in order, and totals by code."""
    keys = [-F.col("lines"), -F.col("subject_lines")] if sort == "size" else []
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *rules.CANONICAL)
    shown = F.struct("code", "path", "line", "col", "ref", "severity", "confidence", "component", "lines")
    live = findings.where("not withheld")
    listed = live.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), shown.alias("f")))), lambda x: x["f"]).alias("findings"))
    sums = rules.totals(findings).agg(F.array_sort(F.collect_list(F.struct("code", "severity", "findings", "components", "lines"))).alias("totals"))
    return listed.crossJoin(F.broadcast(sums)).select(F.to_json(F.struct(F.lit(1).alias("version"), "findings", "totals")).alias("json"))  # one row beside one row


def _json(findings: DataFrame) -> DataFrame:
    """The report as lines of one document: its head, a line for each published finding in order, and its tail with the totals, so no task holds them all."""
    live = findings.where("not withheld")
    first = live.select(F.struct(*rules.CANONICAL).alias("k")).agg(F.min("k").alias("first"))
    shown = F.to_json(F.struct("code", "path", "line", "col", "ref", "severity", "confidence", "component", "lines"))
    rows = live.withColumn("nth", F.row_number().over(Window.partitionBy(*rules.CANONICAL).orderBy("component", "lines")))
    comma = F.when((F.struct(*rules.CANONICAL) == F.col("first")) & (F.col("nth") == 1), "").otherwise(",")
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(rules.CANONICAL, ("string", "int", "int", "string", "string"), strict=True)]
    body = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("at"), *rules.CANONICAL, "nth", F.concat(comma, shown).alias("value"))  # beside one row
    sums = rules.totals(findings).agg(F.to_json(F.array_sort(F.collect_list(F.struct("code", "severity", "findings", "components", "lines")))).alias("totals"))  # a row for each code
    head = findings.sparkSession.range(1).select(F.lit(0).alias("at"), *none, F.lit(0).alias("nth"), F.lit('{"version":1,"findings":[').alias("value"))
    tail = sums.select(F.lit(2).alias("at"), *none, F.lit(0).alias("nth"), F.concat(F.lit('],"totals":'), "totals", F.lit("}")).alias("value"))
    return head.unionByName(body).unionByName(tail).orderBy("at", *rules.CANONICAL, "nth").select("value")


def _said(findings: DataFrame) -> str:
    return "message" if "message" in findings.columns else "ref"


#: format -> findings -> rows of one column, ``value``.
RENDERINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "json": _json,
    "text": lambda f: rules.ordered(f.where("not withheld")).select(rules.text_line(_said(f)).alias("value")),
    "annotations": lambda f: rules.ordered(f.where("not withheld")).select(rules.annotation_line(_said(f)).alias("value")),
    "sarif": lambda f: rules.sarif(f).select(F.col("sarif").alias("value")),
}


def write(findings: DataFrame, form: str, path: str) -> None:
    """Write a rendering; Spark's commit protocol makes it appear whole or not at all. Line formats keep their order across part files."""
    RENDERINGS[form](findings).write.mode("overwrite").text(path)


def rendered(findings: DataFrame, text: str) -> str:
    """A user's template over the report, which is checked against its own schema first."""
    document = json.loads(report(findings).first()["json"])
    if broken := refusals(document, REPORT_SCHEMA):
        raise ValueError("the report breaks its schema: " + "; ".join(broken[:5]))
    return templates.render(templates.parse(text), document)


def baseline_document(findings: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(scheme, code, ref, path): own rows beside the rows of other schemes, bytewise by scheme."""
    own = rules.baseline_rows(findings).withColumn("scheme", F.lit("ts"))
    rows = own if kept is None else own.unionByName(kept.where("scheme <> 'ts'").select(*own.columns))
    return rows.select("scheme", "code", "ref", "path").orderBy("scheme", "path", "code", "ref")


def configuration_lines(config: Config) -> list[str]:
    """``setting<TAB>value`` of every setting, in order."""
    return [f"{k}\t{json.dumps(v)}" for k, v in sorted(vars(config).items())]


def describe() -> list[dict]:
    """The issue vocabulary."""
    return [{"code": c, "name": n, "severity": s} for c, n, s in rules.KINDS]
