"""From judged subjects to published findings: codes, severity, confidence, dials, suppression, totals, renderings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietus.operators import selfcheck
from quietus.session import cut, kept

# The issue vocabulary: code, name, default severity. Fixed values.
KINDS = [
    ("DS1001", "unused-exported", "deny"), ("DS1002", "unused-unexported", "deny"), ("DS1003", "unused-member", "deny"), ("DS1004", "unused-import", "deny"),
    ("DS1005", "unused-enum-member", "deny"), ("DS1006", "unused-type-parameter", "deny"), ("DS1101", "unreachable-export", "deny"), ("DS1102", "test-only-use", "deny"),
    ("DS1103", "test-of-dead-code", "deny"), ("DS1104", "deprecated-unused", "deny"), ("DS1201", "unused-interface", "deny"), ("DS1202", "uncalled-interface-method", "warn"),
    ("DS1301", "write-only-symbol", "deny"), ("DS1401", "unused-parameter", "warn"), ("DS1403", "unused-result", "warn"), ("DS1404", "dead-store", "deny"),
    ("DS1405", "unreachable-statement", "deny"), ("DS1406", "unreachable-case", "deny"), ("DS1501", "unnecessary-export", "warn"), ("DS1503", "redundant-export-keyword", "warn"),
    ("DS1601", "file-never-built", "deny"), ("DS1602", "file-never-imported", "deny"), ("DS1701", "unused-dependency", "deny"), ("DS9001", "suppression-without-reason", "deny"),
    ("DS9002", "unscoped-suppression", "deny"), ("DS9003", "stale-suppression", "deny"), ("DS9004", "unmatched-root", "deny"), ("DS9006", "unmatched-configured-declaration", "deny"),
]
CONFIDENCES = ["possible", "probable", "certain"]
SEVERITIES = ["allow", "warn", "deny"]


def rank(column: str | Column, order: list[str]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*map(F.lit, order)), c).cast("int")


def named(position: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), position)


def severity_of(code: str, overrides: dict[str, str]) -> Column:
    """A code's own setting, else its family's (first four characters), else the vocabulary's."""
    stated = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else F.create_map().cast("map<string,string>")
    default = F.create_map(*[F.lit(x) for c, _, s in KINDS for x in (c, s)])
    return F.coalesce(F.try_element_at(stated, F.col(code)), F.try_element_at(stated, F.substring(code, 1, 4)), F.try_element_at(default, F.col(code)))


def confidence(findings: DataFrame, roots_complete: bool = False) -> DataFrame:
    """Own class, under the ceiling of a death by reachability alone, then under its component's: the lowest of its root findings. Test-used findings are possible on their own."""
    ceiling = F.when((F.col("relation") == "reachability") & F.lit(not roots_complete), 2).otherwise(3)
    own = F.least(rank("confidence", CONFIDENCES), ceiling)
    rows = findings.withColumns({"own": own, "alone": F.when(F.col("test_used"), 1).otherwise(own)})
    cap = rows.where("is_root").groupBy("component").agg(F.min("own").alias("cap"))
    rows = rows.join(cap, "component", "left")
    return rows.withColumn("confidence", named(F.least("alone", F.coalesce("cap", F.lit(3))), CONFIDENCES)).drop("own", "alone", "cap")


def withheld(findings: DataFrame, least: str, overrides: dict[str, str]) -> DataFrame:
    """Adds severity and withheld: by its own severity or confidence, or because a root of its component is withheld."""
    rows = findings.withColumn("severity", severity_of("code", overrides))
    rows = rows.withColumn("own", (F.col("severity") == "allow") | (rank("confidence", CONFIDENCES) < CONFIDENCES.index(least) + 1))
    falls = rows.where("is_root and own").select("component").distinct().withColumn("falls", F.lit(True))
    return rows.join(falls, "component", "left").withColumn("withheld", F.col("own") | F.coalesce("falls", F.lit(False))).drop("own", "falls")


def withheld_counts(findings: DataFrame, least: str) -> DataFrame:
    """(confidence, n): findings that only the least confidence withholds."""
    low = (rank("confidence", CONFIDENCES) < CONFIDENCES.index(least) + 1) & (F.col("severity") != "allow")
    return findings.where(low).groupBy("confidence").agg(F.count("*").alias("n"))


#: What a claim takes: all findings of one code at one position.
POSITION = ["code", "path", "line", "col"]


def claims(findings: DataFrame, records: DataFrame) -> DataFrame:
    """(finding, POSITION, withheld, record_ord): the findings that each record claims. ``finding`` is added where it is missing.

    A record claims what it names (``selfcheck.named``) and no earlier one has; who claims one finding of a code at a position has taken that position for the code.
    """
    rows = findings if "finding" in findings.columns else findings.withColumn("finding", F.concat_ws("\u0000", *POSITION, "declaration", "ref"))
    rows = kept(rows.select("finding", *POSITION, "declaration", "ref", "withheld", *({"holder"} & set(rows.columns))), "findings")
    # Who takes a position is the first record that names anything at it, and so the first that names what it claims there: no finding's further records count.
    hits = kept(selfcheck.claimed(rows, records).join(rows.select("finding", *POSITION, "withheld").distinct(), "finding"), "claims")
    owner = hits.groupBy(*POSITION).agg(F.min("record_ord").alias("record_ord"))
    return hits.join(owner, [*POSITION, "record_ord"])


def ledger(findings: DataFrame, records: DataFrame, allowed: list[str] | None = None, holds: DataFrame | None = None, claimed: DataFrame | None = None) -> DataFrame:
    """(record_ord, verdict, claimed): in-effect, dormant or stale.

    A record is dormant where all it claims is withheld, or where it is bound, claims none, and its code is ``allowed`` or a hold (``holds``: id) keeps its declaration. ``claimed``: what ``claims`` gives, if it is known.
    """
    taken = claims(findings, records) if claimed is None else claimed
    n = taken.groupBy("record_ord").agg(F.count("*").alias("claimed"), F.bool_and("withheld").alias("all_withheld"))
    rows = records.join(n, "record_ord", "left")
    if holds is None:
        rows = rows.withColumn("hold", F.lit(False))
    else:
        rows = rows.join(holds.select(F.col("id").alias("bound"), F.lit(True).alias("hold")).distinct(), "bound", "left").na.fill(False, ["hold"])
    dormant = F.when(F.col("claimed").isNull(), (F.col("bound") != "") & (F.col("code").isin(allowed or []) | F.col("hold"))).otherwise(F.col("all_withheld"))
    verdict = F.when(dormant, "dormant").when(F.col("claimed").isNull(), "stale").otherwise("in-effect")
    return rows.select("record_ord", verdict.alias("verdict"), F.coalesce("claimed", F.lit(0)).alias("claimed"))


def stale_sites(verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """(site, mechanism, codes): entries all of whose records are stale, with the codes in order."""
    rows = records.join(verdicts, "record_ord").groupBy("site", "mechanism", "symbol", "code").agg(F.bool_and(F.col("verdict") == "stale").alias("stale"))
    return rows.where("stale").groupBy("site", "mechanism").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def baseline_rows(findings: DataFrame) -> DataFrame:
    """(code, ref, path): rows that a baseline records, once each: what is published and may be suppressed."""
    return findings.where("not withheld and code not like 'DS9%'").select("code", "ref", "path").distinct()


def baseline_fixpoint(findings: DataFrame | Callable[[DataFrame], DataFrame], held: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(code, ref, path): the rows a baseline settles on from the rows ``held`` now: rows that name nothing go and never return, findings without a row are added.

    ``findings`` are the run's, or a function that runs the analysis under given rows; it is asked again each round, since a row that goes may bring other findings. Raises if ``max_rounds`` is too few.
    """
    key = ["code", "ref", "path"]
    rows, gone = cut(held.select(*key).distinct()), None
    wanted = None if callable(findings) else cut(baseline_rows(findings))
    for _ in range(max_rounds):
        now = cut(baseline_rows(findings(rows))) if callable(findings) else wanted
        stale = rows.join(now, key, "left_anti")
        gone = cut(stale if gone is None else gone.unionByName(stale).distinct())
        add = now.join(rows, key, "left_anti").join(gone, key, "left_anti")
        if stale.isEmpty() and add.isEmpty():
            return rows
        rows = cut(rows.join(stale, key, "left_anti").unionByName(add))
    raise RuntimeError("the baseline did not settle within max_rounds")


def totals(findings: DataFrame) -> DataFrame:
    """(code, severity, findings, components, lines): published findings by code; a component's lines count once."""
    rows = findings.where("not withheld")
    per = rows.groupBy("code", "severity", "component").agg(F.count("*").alias("n"), F.max("lines").alias("lines"))
    return per.groupBy("code", "severity").agg(F.sum("n").alias("findings"), F.count("*").alias("components"), F.sum("lines").cast("long").alias("lines"))


def deletable_lines(findings: DataFrame) -> DataFrame:
    """(lines): each published component's lines, once."""
    return findings.where("not withheld").groupBy("component").agg(F.max("lines").alias("l")).agg(F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("lines"))


CANONICAL = ["path", "line", "col", "code", "ref"]


def ordered(findings: DataFrame, by: str = "position") -> DataFrame:
    """Findings with no tie left: by position, or by component lines, then subject lines, falling."""
    keys = [F.desc("lines"), F.desc("subject_lines")] if by == "size" else []
    return findings.orderBy(*keys, *CANONICAL)


def top(findings: DataFrame, most: int, by: str = "size") -> DataFrame:
    """The first ``most`` findings (0: all) with their place; the sort is a bounded heap in each task."""
    if not most:
        return findings
    keys = [F.desc("lines"), F.desc("subject_lines")] if by == "size" else []
    head = findings.orderBy(*keys, *CANONICAL).limit(most)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*keys, *CANONICAL)))


def capped(findings: DataFrame, most: int, by: str = "size") -> tuple[DataFrame, int, DataFrame]:
    """(the first ``most`` findings, how many are left out, the components that still have one); 0 keeps all."""
    kept = cut(top(findings, most, by)) if most else findings
    return kept, findings.count() - kept.count() if most else 0, kept.select("component").distinct()


def verdict(findings: DataFrame, stale: DataFrame, fail_on: str = "deny", pending: bool = False) -> int:
    """Exit code: 4 pending, 1 failing findings or stale suppressions, 0 clean."""
    if pending:
        return 4
    failing = findings.where(~F.col("withheld") & (rank("severity", SEVERITIES) >= SEVERITIES.index(fail_on) + 1))
    return int(not failing.isEmpty() or not stale.isEmpty())


def part_verdicts(found: DataFrame, judging: DataFrame) -> DataFrame:
    """(declaration, name, stands): a part stands if every configuration that judges its declaration found it; relational division by counts."""
    judges = judging.distinct().groupBy("declaration").agg(F.count("*").alias("judges"))
    by = found.select("configuration", "declaration", "name").distinct().groupBy("declaration", "name").agg(F.count("*").alias("finds"))
    return by.join(judges, "declaration").select("declaration", "name", (F.col("finds") == F.col("judges")).alias("stands"))


def unused_imports(found: DataFrame) -> DataFrame:
    """(declaration, name): used in no configuration."""
    return found.groupBy("declaration", "name").agg(F.bool_or("in_use").alias("used")).where("not used").select("declaration", "name")


def unused_dependencies(declared: DataFrame, needs: DataFrame, ran: DataFrame, dead: DataFrame) -> DataFrame:
    """(dir, name, state): declared, not run; unused where nothing needs it, dead where only dead declarations do. ``needs``: at, name, owner."""
    rest = declared.distinct().join(ran.select("name").distinct(), "name", "left_anti")
    live = needs.join(dead.select(F.col("id").alias("owner"), F.lit(True).alias("d")), "owner", "left").groupBy(F.col("at").alias("dir"), "name").agg(F.bool_and(F.col("d").isNotNull()).alias("all_dead"))
    state = F.when(F.col("all_dead").isNull(), "unused").when(F.col("all_dead"), "dead")
    return rest.join(live, ["dir", "name"], "left").select("dir", "name", state.alias("state")).where("state is not null")


def last_uses(needs: DataFrame) -> DataFrame:
    """(at, name, owner): packages that one declaration alone needs."""
    return needs.groupBy("at", "name").agg(F.countDistinct("owner").alias("n"), F.min("owner").alias("owner")).where("n = 1").drop("n")


def edge_evaluations(sides: DataFrame, judged: DataFrame) -> DataFrame:
    """(edge, state, live, absent): an edge between languages is live if a symbol of either side is, absent if it has none, else dead."""
    rows = sides.join(judged.select(F.col("id").alias("symbol"), "dead"), "symbol", "left")
    per = rows.groupBy("edge").agg(F.count_if(F.col("dead").isNotNull() & ~F.col("dead")).alias("live"), F.count_if(F.col("dead").isNull()).alias("absent"), F.count("*").alias("n"))
    return per.select("edge", F.when(F.col("live") > 0, "live").when(F.col("absent") == F.col("n"), "absent").otherwise("dead").alias("state"), "live", "absent")


def text_line(said: str = "ref") -> Column:
    return F.format_string("%s:%d:%d: %s %s (%s, %s)", "path", "line", "col", "code", said, "severity", "confidence")


def annotation_line(said: str = "ref") -> Column:
    """A workflow command: data and properties escaped, severity as level."""
    level = F.when(F.col("severity") == "deny", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    data = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(data(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return F.concat(F.lit("::"), level, F.lit(" file="), prop(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), prop(F.col("code")), F.lit("::"), data(F.col(said)))


def sarif(findings: DataFrame, pieces: int = 1) -> DataFrame:
    """``sarif``: all published findings as a SARIF 2.1.0 log of one row, or as ``pieces`` logs, dealt out by hash, each whole in itself. An empty piece has no row, unless it is the only one."""
    level = F.when(F.col("severity") == "deny", "error").when(F.col("severity") == "warn", "warning").otherwise("note")
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message" if "message" in findings.columns else "ref").alias("text")).alias("message"), F.array(location).alias("locations"), F.struct(F.sha2(F.concat_ws("\n", "code", "ref"), 256).alias("symbol/v1")).alias("partialFingerprints"))
    keyed = findings.where("not withheld").select(F.struct(*CANONICAL).alias("k"), result.alias("r"))
    dealt = keyed.groupBy(F.pmod(F.xxhash64("k"), F.lit(pieces))) if pieces > 1 else keyed
    listed = dealt.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("results"))
    rules = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(n).alias("name")) for c, n, _ in KINDS])
    driver = F.struct(F.lit("quietus").alias("name"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    return listed.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def merge_implementations(classes: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over configurations: (interface_id, classes) as a sorted list, and (method_id, class_id, empty), empty only if every configuration saw an empty body."""
    listed = classes.groupBy("interface_id").agg(F.array_join(F.array_sort(F.collect_set("class_id")), ",").alias("classes"))
    return listed, bodies.groupBy("method_id", "class_id").agg(F.bool_and("empty").alias("empty"))


def test_ceilings(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, ceiling): the lowest confidence among the targets of each test. ``targets`` (id, target), ``classes`` (target, confidence)."""
    return targets.join(classes, "target").groupBy("id").agg(F.min(rank("confidence", CONFIDENCES)).alias("r")).select("id", named(F.col("r"), CONFIDENCES).alias("ceiling"))


def unanswered_counts(questions: DataFrame) -> DataFrame:
    """(configuration, questions, declarations) that no answer came to."""
    return questions.groupBy("configuration").agg(F.count("*").alias("questions"), F.countDistinct("id").alias("declarations"))


def brand_members(members: DataFrame, namers: DataFrame) -> DataFrame:
    """(id): members that only unreferenced members of the same owner name. ``members`` (id, owner, refs), ``namers`` (id, namer)."""
    at = members.select(F.col("id").alias("namer"), F.col("owner").alias("namer_owner"), F.col("refs").alias("namer_refs"))
    rows = members.join(namers, "id").join(at, "namer", "left")
    fits = F.coalesce((F.col("owner") == F.col("namer_owner")) & (F.col("namer_refs") == 0), F.lit(False))
    return rows.groupBy("id").agg(F.bool_and(fits).alias("brand")).where("brand").select("id")


def ledger_counts(verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """(in_effect, sites): records in effect, and distinct sites that hold one."""
    live = records.join(verdicts.where("verdict = 'in-effect'"), "record_ord")
    return live.agg(F.count("*").alias("in_effect"), F.countDistinct("site").alias("sites"))


def carried(references: DataFrame) -> DataFrame:
    """(id, chains): distinct carriers of the references to a declaration; none at all if one counted reference has no carrier. ``references`` (to_id, carriers array)."""
    rows = references.groupBy(F.col("to_id").alias("id")).agg(F.min(F.size("carriers")).alias("least"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("carriers")))), ",").alias("chains"))
    return rows.where("least > 0").select("id", "chains")


def lower_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the lower middle value."""
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("median"))


def component_listing(components: DataFrame, cascade: bool) -> DataFrame:
    """(component, members): a component's roots, or with ``cascade`` all its members, in order."""
    rows = components if cascade else components.where("root")
    return rows.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("members"))
