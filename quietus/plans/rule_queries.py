"""The rules for codes, parts, self-checks and records as queries, beside SQL written from the rules themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietus.facts.adapters import ctes, fact
from quietus.functions.globs import ref_like
from quietus.operators import codes, selfcheck
from quietus.plans.queries import query

# --- codes of dead declarations -------------------------------------------------------------------------------------

_ONLY_TEST = "(in_test AND NOT unreferenced_test)"
_SHAPE = "CASE WHEN kind IN ('method', 'class-member', 'type-member', 'enum-member') THEN CASE WHEN brand THEN NULL ELSE 'DS1003' END WHEN NOT exported THEN 'DS1002' WHEN encapsulated AND parent_kind = 'file' AND NOT rooted AND NOT ((test > 0 AND (production = 0 OR kept_by_tests)) OR (production = 0 AND deprecated)) THEN 'DS1101' ELSE 'DS1001' END"
_USE = f"CASE WHEN unreferenced_test THEN {_SHAPE} WHEN held_by_itself THEN 'DS1102' WHEN production = 0 AND deprecated THEN 'DS1104' WHEN test > 0 AND (production = 0 OR (relation = 'reachability' AND kept_by_tests)) THEN 'DS1102' ELSE {_SHAPE} END"
_KIND = f"CASE kind WHEN 'interface' THEN CASE WHEN NOT {_ONLY_TEST} THEN 'DS1201' END WHEN 'interface-method' THEN CASE WHEN NOT {_ONLY_TEST} AND production + test = 0 AND NOT container_dead AND NOT marker THEN 'DS1202' END WHEN 'type-parameter' THEN CASE WHEN production + test = 0 AND NOT container_dead AND parent_kind IN ('function', 'method', 'type') THEN 'DS1006' END WHEN 'enum-member' THEN CASE WHEN NOT container_dead THEN 'DS1005' END END"
_OWN = "kind IN ('file', 'interface', 'interface-method', 'type-parameter') OR (kind = 'enum-member' AND production + test = 0)"


def _dead_sql(fallen: bool) -> str:
    own = "container_dead" if fallen else "NOT container_dead"
    return f"CASE WHEN {own} AND test_of_dead THEN 'DS1103' WHEN {_OWN} THEN {'NULL' if fallen else _KIND} WHEN NOT ({own}) OR {_ONLY_TEST} THEN NULL ELSE {_USE} END"


@query(ctes("candidates") + f", c AS (SELECT id, kind, {_dead_sql(False)} AS code FROM candidates) SELECT * FROM c WHERE code IS NOT NULL")
def code_table_dead(spark, sf):
    rows = codes.with_flags(fact(spark, sf, "candidates")).withColumn("code", codes.code_of_dead())
    return rows.where("code is not null").select("id", "kind", "code")


@query(ctes("candidates") + f", c AS (SELECT id, kind, {_dead_sql(True)} AS code FROM candidates) SELECT * FROM c WHERE code IS NOT NULL")
def code_table_fallen(spark, sf):
    rows = codes.with_flags(fact(spark, sf, "candidates")).withColumn("code", codes.code_of_dead(fallen=True))
    return rows.where("code is not null").select("id", "kind", "code")


def _one_code(code: str):
    """A query of one code's findings."""
    sql = ctes("candidates") + f", c AS (SELECT id, parent_kind, {_dead_sql(False)} AS code FROM candidates) SELECT id, parent_kind FROM c WHERE code = '{code}'"

    def run(spark, sf):
        return codes.with_flags(fact(spark, sf, "candidates")).where(codes.code_of_dead() == code).select("id", "parent_kind")

    run.__name__ = {"DS1005": "unused_enum_members", "DS1006": "unused_type_parameters", "DS1101": "unreachable_exports", "DS1202": "uncalled_interface_methods"}[code]
    query(sql)(run)


for _code in ("DS1005", "DS1006", "DS1101", "DS1202"):
    _one_code(_code)

# --- roots and codes of live declarations ---------------------------------------------------------------------------

_KINDS = ", rk AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {p}, {r})" for k, p, r in codes.ROOT_KINDS) + ") v(kind, publishes, run_only)), fl AS (SELECT r.id, r.kind, publishes, run_only, NOT publishes AND NOT run_only AND r.kind NOT IN ('entry-reach', 'test-reach') AS enters FROM subject_roots r JOIN rk USING (kind))"
_ENTERED = (
    _KINDS
    + ", ow AS (SELECT id, bool_or(publishes) AS p, bool_or(enters) AS e FROM fl GROUP BY id), pf AS (SELECT DISTINCT s.path FROM subjects s JOIN ow USING (id) WHERE p)"
    + ", fw AS (SELECT s.path, bool_or(enters AND fl.kind NOT IN ('document-import', 'test-runner')) AS wide, bool_or(enters AND fl.kind <> 'document-import') AS called FROM fl JOIN subjects s ON s.id = fl.id AND s.kind = 'file' GROUP BY s.path)"
    + ", en AS (SELECT s.*, coalesce(p, false) AS published, coalesce(e, false) AS by_name, s.path IN (SELECT path FROM pf) AS file_published, coalesce(wide, false) OR (coalesce(called, false) AND (s.kind = 'function' OR list_contains(string_split(s.path, '/'), '__mocks__'))) AS file_by_name FROM subjects s LEFT JOIN ow USING (id) LEFT JOIN fw ON fw.path = s.path)"
)


@query(ctes("subjects", "subject_roots") + _KINDS + " SELECT kind, publishes, run_only, enters, count(*) AS n FROM fl GROUP BY ALL")
def root_kind_flags(spark, sf):
    return codes.root_flags(fact(spark, sf, "subject_roots")).groupBy("kind", "publishes", "run_only", "enters").agg(F.count("*").alias("n"))


@query(ctes("subjects", "subject_roots") + _ENTERED + " SELECT id, published, by_name, file_published, file_by_name FROM en")
def entered_by_roots(spark, sf):
    return codes.entered(fact(spark, sf, "subjects"), fact(spark, sf, "subject_roots"))


def _live(spark, sf, closed):
    rows = fact(spark, sf, "subjects").join(codes.entered(fact(spark, sf, "subjects"), fact(spark, sf, "subject_roots")), "id")
    return rows.withColumn("code", codes.code_of_live(closed)).where("code is not null").select("id", "code")


_NARROW = _ENTERED + ", j AS (SELECT * FROM en WHERE exported AND parent_kind = 'file' AND NOT written AND kind <> 'export-alias' AND NOT by_name AND NOT file_by_name AND named > 0)"


@query(ctes("subjects", "subject_roots") + _NARROW + " SELECT id, 'DS1503' AS code FROM j WHERE scope = 'file' AND NOT file_published")
def narrowing_in_an_open_world(spark, sf):
    return _live(spark, sf, False)


@query(ctes("subjects", "subject_roots") + _NARROW + " SELECT id, 'DS1503' AS code FROM j WHERE scope = 'file' UNION ALL SELECT id, 'DS1501' FROM j WHERE scope = 'package' AND published AND NOT exposed")
def narrowing_in_a_closed_world(spark, sf):
    return _live(spark, sf, True)


@query(ctes("subjects") + " SELECT id FROM subjects WHERE kind = 'function' OR list_contains(string_split(path, '/'), '__mocks__')")
def runner_calls(spark, sf):
    return fact(spark, sf, "subjects").where(codes.runner_calls()).select("id")


# --- parts of functions ---------------------------------------------------------------------------------------------

_PARTS = ctes("function_parts", "function_signatures", "calls") + (
    ", dis AS (SELECT declaration FROM calls GROUP BY declaration HAVING bool_and(use = 'discarded')), p AS (SELECT p.*, coalesce(s.state, 'fixed') AS state, coalesce(s.rooted, false) AS rooted, coalesce(s.callers_unknown, false) AS unknown, p.declaration IN (SELECT declaration FROM dis) AS discarded FROM function_parts p LEFT JOIN function_signatures s USING (declaration))"
    ", q AS (SELECT *, CASE WHEN kind = 'parameter' AND NOT in_value AND state = 'free' THEN CASE WHEN annotated IS NULL THEN CASE WHEN counted AND rooted THEN 'delete probable' ELSE 'delete certain' END END"
    " WHEN kind = 'parameter' AND (in_value OR state = 'valued') THEN CASE WHEN before_a_read THEN 'rename certain' WHEN annotated = 'steers' THEN NULL WHEN coalesce(annotated, '') = 'free' OR contextual OR counted THEN 'delete probable' ELSE 'delete certain' END"
    " WHEN kind = 'parameter' THEN NULL WHEN kind = 'result' THEN CASE WHEN state = 'free' AND discarded AND NOT unknown THEN 'delete certain' END ELSE 'delete certain' END AS said FROM p)"
)


@query(_PARTS + " SELECT declaration, kind, name, CASE kind WHEN 'parameter' THEN 'DS1401' WHEN 'result' THEN 'DS1403' WHEN 'dead-store' THEN 'DS1404' WHEN 'unreachable-statement' THEN 'DS1405' ELSE 'DS1406' END AS code, split_part(said, ' ', 1) AS fix, split_part(said, ' ', 2) AS confidence FROM q WHERE said IS NOT NULL")
def part_findings(spark, sf):
    signatures = fact(spark, sf, "function_signatures")
    return codes.part_findings(fact(spark, sf, "function_parts"), signatures.select("declaration", "state"), signatures.where("rooted").select("declaration"), signatures.where("callers_unknown").select("declaration"), codes.discarded_everywhere(fact(spark, sf, "calls")))


@query(ctes("calls") + " SELECT declaration FROM calls GROUP BY declaration HAVING count(*) FILTER (WHERE use <> 'discarded') = 0")
def discarded_everywhere(spark, sf):
    return codes.discarded_everywhere(fact(spark, sf, "calls"))


@query(ctes("symbols", "skipped") + " SELECT id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM skipped k WHERE k.path = s.path AND s.line BETWEEN k.from_line AND k.to_line)")
def outside_skipped(spark, sf):
    return codes.outside_skipped(fact(spark, sf, "symbols"), fact(spark, sf, "skipped")).select("id")


@query(ctes("cases") + " SELECT switch, position, key FROM (SELECT *, min(position) OVER (PARTITION BY switch, key) AS first FROM cases WHERE key IS NOT NULL) WHERE position > first")
def repeated_cases(spark, sf):
    return codes.repeated_cases(fact(spark, sf, "cases"))


# --- what nothing answers to ----------------------------------------------------------------------------------------


@query(ctes("written_records") + " SELECT record_ord, 'DS9001' AS code FROM written_records WHERE reason IS NULL OR trim(reason) = '' UNION ALL SELECT record_ord, 'DS9002' FROM written_records WHERE coalesce(path, '') = ''")
def refused_suppressions(spark, sf):
    return selfcheck.refused(fact(spark, sf, "written_records"))


@query(ctes("asked_roots", "matched_roots") + " SELECT source FROM asked_roots EXCEPT SELECT source FROM matched_roots WHERE found > 0")
def unmatched_roots(spark, sf):
    return selfcheck.unmatched_everywhere(fact(spark, sf, "asked_roots"), fact(spark, sf, "matched_roots"))


@F.pandas_udf(T.StringType())
def _likes(sources: pd.Series) -> pd.Series:
    return sources.map(ref_like)  # configuration: a row for each pattern


@query(ctes("symbols", "root_patterns", "refs_of_symbols") + " SELECT DISTINCT source FROM root_patterns p WHERE NOT EXISTS (SELECT 1 FROM refs_of_symbols s WHERE s.ref LIKE replace(replace(p.source, '*', '%'), '?', '_'))")
def unmatched_root_patterns(spark, sf):
    patterns = fact(spark, sf, "root_patterns").distinct()
    matched = selfcheck.root_pattern_matches(fact(spark, sf, "refs_of_symbols"), patterns.withColumn("like", _likes("source")))
    found = matched.groupBy("source").agg(F.count("*").alias("found")).withColumn("project", F.lit("p"))
    return selfcheck.unmatched_everywhere(patterns, found)


@query(ctes("symbols", "root_patterns", "refs_of_symbols") + " SELECT source, count(DISTINCT s.id) AS n, min(s.id) AS first FROM (SELECT DISTINCT source FROM root_patterns) p JOIN refs_of_symbols s ON s.ref LIKE replace(replace(p.source, '*', '%'), '?', '_') GROUP BY source")
def root_pattern_matches(spark, sf):
    patterns = fact(spark, sf, "root_patterns").distinct()
    matched = selfcheck.root_pattern_matches(fact(spark, sf, "refs_of_symbols"), patterns.withColumn("like", _likes("source")))
    return matched.groupBy("source").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"))


@query(ctes("symbols", "tree_files") + " SELECT path FROM tree_files EXCEPT SELECT path FROM symbols")
def files_never_built(spark, sf):
    return selfcheck.never_built(fact(spark, sf, "tree_files"), fact(spark, sf, "symbols"), complete=True)


@query(ctes("projects") + " SELECT project, CASE WHEN status = 'read' THEN 'analysed' WHEN status = 'unreadable' AND named AND NOT optional THEN 'failed' ELSE 'dropped' END AS state FROM projects")
def run_states(spark, sf):
    return selfcheck.run_states(fact(spark, sf, "projects"))


@query(ctes("symbols", "refs_of_symbols", "loose_findings") + ", w AS (SELECT *, coalesce(holder, ref) AS wanted FROM loose_findings) SELECT finding, CASE WHEN kind IN ('file', 'dependency', 'record') THEN '' ELSE coalesce((SELECT min(id) FROM refs_of_symbols s WHERE s.path = w.path AND s.line = w.line AND s.ref = w.wanted), (SELECT arg_min(id, s.line) FROM refs_of_symbols s WHERE s.path = w.path AND s.ref = w.wanted), CASE WHEN kind = 'import' THEN path || ':' || line ELSE '' END) END AS declaration FROM w")
def bound_declarations(spark, sf):
    return selfcheck.bound_declarations(fact(spark, sf, "loose_findings"), fact(spark, sf, "refs_of_symbols"))


_MAY = "(subject IN ('declaration', 'part') OR (subject IN ('file', 'dependency') AND r.mechanism <> 'inline'))"


@query(
    ctes("spoken_findings", "spoken_records")
    + ", f AS (SELECT *, CASE WHEN code IN ('DS1401', 'DS1403', 'DS1404', 'DS1405', 'DS1406') THEN 'part' WHEN code IN ('DS1601', 'DS1602') THEN 'file' WHEN code = 'DS1701' THEN 'dependency' WHEN code LIKE 'DS9%' THEN 'record' ELSE 'declaration' END AS subject FROM spoken_findings)"
    + f" SELECT f.finding, min(r.record_ord) AS record_ord FROM f JOIN spoken_records r ON f.code = r.code WHERE {_MAY} AND CASE WHEN r.mechanism = 'inline' THEN r.bound <> '' AND r.bound = f.declaration AND r.site_path = f.path ELSE r.path = f.path AND (r.symbol = f.ref OR r.symbol = f.holder) AND (f.declaration = '' OR f.declaration = r.bound OR NOT EXISTS (SELECT 1 FROM spoken_records o WHERE o.mechanism = r.mechanism AND o.site = r.site AND o.code = r.code AND o.bound = f.declaration)) END GROUP BY f.finding"
)
def claims_by_mechanism(spark, sf):
    return selfcheck.claimed(fact(spark, sf, "spoken_findings"), fact(spark, sf, "spoken_records"))
