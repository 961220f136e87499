"""Every operator as a query over the star-schema tables, beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietus.facts.adapters import ctes, fact
from quietus.functions import paths, semver, text
from quietus.functions.globs import ref_like
from quietus.graph import edges, matrix
from quietus.graph.components import weak_components
from quietus.graph.scc import referenced_cycles, strong_components
from quietus.graph.walk import carrier_reach, peer_closure, reach, support_files
from quietus.operators import carriers, codes, exemptions, joins, liveness, patterns, rules
from quietus.plans import analysis
from quietus.session import cut
from quietus.sources import conventions, manifests, tree

#: Findings that one row of the SARIF log holds, about.
SARIF_PIECE = 10_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the union over configurations ---------------------------------------------------------------------------------


@query(ctes("symbols") + " SELECT kind, count(*) AS n, count(DISTINCT path) AS paths, count(*) FILTER (WHERE exported) AS exported, min(line) AS first_line, max(end_line) AS last_line FROM symbols GROUP BY kind")
def load_symbols(spark, sf):
    return fact(spark, sf, "symbols").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.count_if("exported").alias("exported"), F.min("line").alias("first_line"), F.max("end_line").alias("last_line"))


@query(ctes("cfg_symbols") + " SELECT id, configuration, config_ord, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY config_ord) AS k FROM cfg_symbols WHERE NOT reference_only) WHERE k = 1")
def merge_symbols(spark, sf):
    return matrix.merge_symbols(fact(spark, sf, "cfg_symbols")).select("id", "configuration", "config_ord", "kind")


@query(ctes("cfg_symbols") + " SELECT id, string_agg(configuration, ',' ORDER BY config_ord) AS configurations, count(*) AS n_configurations FROM (SELECT DISTINCT id, config_ord, configuration FROM cfg_symbols) GROUP BY id")
def held_in(spark, sf):
    return matrix.held_in(fact(spark, sf, "cfg_symbols"))


@query(ctes("cfg_refs") + ", f AS (SELECT *, min(config_ord) OVER (PARTITION BY consumer, from_id, to_id, path, line, col, use) AS first FROM cfg_refs), m AS (SELECT from_id, to_id, line, use, string_agg(configuration, ',' ORDER BY config_ord) AS makers FROM (SELECT DISTINCT from_id, to_id, line, use, configuration, config_ord FROM cfg_refs) GROUP BY ALL) SELECT f.from_id, f.to_id, f.line, f.use, f.ref_ord, m.makers FROM f JOIN m USING (from_id, to_id, line, use) WHERE f.config_ord = f.first")
def merge_references(spark, sf):
    return matrix.merge_references(fact(spark, sf, "cfg_refs")).select("from_id", "to_id", "line", "use", "ref_ord", "makers")


@query(ctes("cfg_symbols") + " SELECT DISTINCT id FROM cfg_symbols WHERE reference_only EXCEPT SELECT id FROM cfg_symbols WHERE NOT reference_only")
def unjudged(spark, sf):
    return matrix.unjudged(fact(spark, sf, "cfg_symbols"))


@query(ctes("suppressions") + " SELECT site, code, min(record_ord) AS record_ord FROM suppressions GROUP BY ALL")
def first_facts(spark, sf):
    return matrix.first_facts(fact(spark, sf, "suppressions"), ["site", "code"], ["record_ord"]).select("site", "code", "record_ord")


# --- counts, predicates and joins ----------------------------------------------------------------------------------

COUNTS = ctes("symbols", "refs") + ", counts AS (SELECT to_id AS id, CAST(count(*) FILTER (WHERE NOT guessed AND NOT test) AS BIGINT) AS production, count(*) FILTER (WHERE NOT guessed AND test) AS test, count(*) FILTER (WHERE NOT guessed AND test AND consumer <> '') AS consumer_test, count(*) FILTER (WHERE guessed) AS guessed_refs FROM refs WHERE to_id IN (SELECT id FROM symbols) GROUP BY to_id)"


@query(COUNTS + " SELECT * FROM counts")
def reference_counts(spark, sf):
    return edges.reference_counts(fact(spark, sf, "refs"), fact(spark, sf, "symbols"))


@query(ctes("refs") + " SELECT CASE WHEN use IN ('evaluation', 'write') THEN 'none' WHEN NOT namespace THEN 'whole' WHEN reexport THEN 'passes' ELSE 'none' END AS reads, use, count(*) AS n FROM refs GROUP BY ALL")
def edge_modes(spark, sf):
    return fact(spark, sf, "refs").groupBy(edges.reads_of().alias("reads"), "use").agg(F.count("*").alias("n"))


@query(ctes("symbols", "refs") + " SELECT to_id AS id, CASE max(CASE WHEN consumer <> '' THEN 2 WHEN r.path <> s.path THEN 1 ELSE 0 END) WHEN 2 THEN 'outside' WHEN 1 THEN 'package' ELSE 'file' END AS scope, count(*) AS named FROM refs r JOIN symbols s ON r.to_id = s.id GROUP BY to_id")
def visibility_reach(spark, sf):
    return edges.visibility_reach(fact(spark, sf, "refs"), fact(spark, sf, "symbols"))


@query(ctes("store_refs", "exempt") + " SELECT to_id AS id, count(DISTINCT (path, line)) FILTER (WHERE use = 'write') AS writes FROM store_refs GROUP BY to_id HAVING count(*) FILTER (WHERE use = 'write') > 0 AND count(*) FILTER (WHERE use <> 'write') = 0 AND to_id NOT IN (SELECT id FROM exempt)")
def write_only(spark, sf):
    return edges.write_only(fact(spark, sf, "store_refs"), fact(spark, sf, "exempt"))


@query(ctes("refs") + " SELECT from_id, to_id FROM refs WHERE use = 'write' EXCEPT SELECT from_id, to_id FROM refs WHERE use = 'read'")
def written_only_pairs(spark, sf):
    refs = fact(spark, sf, "refs")
    return refs.where("use = 'write'").select("from_id", "to_id").subtract(refs.where("use = 'read'").select("from_id", "to_id"))


@query(ctes("symbols") + " SELECT coalesce(p.kind, '-') AS parent_kind, s.kind, count(*) AS n, count(*) FILTER (WHERE s.exported) AS exported FROM symbols s LEFT JOIN symbols p ON s.parent = p.id GROUP BY ALL")
def containment(spark, sf):
    return edges.containment(fact(spark, sf, "symbols"))


@query(ctes("symbols") + " SELECT f.id, s.id AS child FROM symbols s JOIN symbols f ON s.parent = f.id AND f.kind = 'file' WHERE s.exported")
def whole_reads(spark, sf):
    return edges.whole_reads(fact(spark, sf, "symbols"))


@query(ctes("dep_files", "manifests") + " SELECT f.dir, f.name, f.owner, arg_max(m.dir, length(m.dir)) AS at FROM dep_files f JOIN (SELECT DISTINCT * FROM manifests) m ON m.name = f.name AND (m.dir = '' OR f.dir = m.dir OR starts_with(f.dir, m.dir || '/')) GROUP BY ALL")
def nearest_ancestor(spark, sf):
    return joins.nearest_ancestor(fact(spark, sf, "dep_files"), fact(spark, sf, "manifests"))


@query(ctes("points", "intervals") + " SELECT point, id FROM (SELECT point, id, row_number() OVER (PARTITION BY point ORDER BY from_line DESC, to_line, id) AS k FROM points p JOIN intervals i ON p.path = i.path AND p.line BETWEEN from_line AND to_line) WHERE k = 1")
def interval_join(spark, sf):
    return joins.innermost_interval(fact(spark, sf, "points"), fact(spark, sf, "intervals"))


@query(ctes("symbols") + r", r AS (SELECT * FROM (VALUES (0, '^src/(.*/)?[^/]*\.ts$'), (1, '^lib/(Brand#11|Brand#2[^/])\.ts$'), (2, '^app/m[0-9]\.ts$'), (3, '^(.*/)?l[^/][^/]*\.ts$')) v(pattern_ord, re)) SELECT path, min(pattern_ord) AS pattern_ord FROM (SELECT DISTINCT path FROM symbols) s JOIN r ON regexp_matches(path, re) GROUP BY path")
def theta_pattern(spark, sf):
    return joins.pattern_matches(fact(spark, sf, "symbols").select("path").distinct(), [(0, "src/**/*.ts"), (1, "lib/{Brand#11,Brand#2?}.ts"), (2, "app/m[0-9].ts"), (3, "**/l?*.ts")])


@query(ctes("symbols") + " SELECT id, name FROM symbols WHERE name LIKE 'Customer#%0_' AND kind = 'class'")
def ref_match(spark, sf):
    return fact(spark, sf, "symbols").where(F.col("name").like(ref_like("Customer#*0?")) & (F.col("kind") == "class")).select("id", "name")


@query(ctes("symbols") + " SELECT lower(name) AS name, id FROM symbols WHERE contains(lower(name), 'er#00000001') ORDER BY name, id LIMIT 20")
def explain_partial(spark, sf):
    return fact(spark, sf, "symbols").where(F.lower("name").contains("er#00000001")).select(F.lower("name").alias("name"), "id").orderBy("name", "id").limit(20)


# --- reachability ---------------------------------------------------------------------------------------------------

EDGES = ", e AS (SELECT r.*, r.from_id IN (SELECT id FROM symbols) AND consumer = '' AS inside, CASE WHEN use IN ('evaluation', 'write') THEN 'none' WHEN NOT namespace THEN 'whole' WHEN reexport THEN 'passes' ELSE 'none' END AS reads FROM refs r WHERE to_id IN (SELECT id FROM symbols))"


def walk_sql(*more: str, gates: bool = False, production: bool = True) -> str:
    """Facts, edges and ``w``: the walk's states, without merging them (the edge rule distributes over their join)."""
    level = "CASE WHEN reads = 'export' THEN level WHEN reads = 'gate' THEN 2 WHEN reads = 'passes' THEN CASE WHEN passing THEN 4 WHEN level >= 2 THEN 3 ELSE 1 END WHEN reads = 'whole' THEN 3 ELSE 1 END"
    first = "CASE WHEN reads = 'passes' THEN 4 WHEN reads = 'whole' THEN 3 ELSE 1 END"
    steps = "SELECT from_id AS node, to_id, reads, test FROM e WHERE inside AND NOT guessed UNION SELECT s.parent, s.id, 'export', false FROM symbols s JOIN symbols f ON s.parent = f.id AND f.kind = 'file' WHERE s.exported"
    if gates:
        steps += " UNION SELECT file, id, 'gate', false FROM gates"
    seeds = f"SELECT id AS node, false AS holds, 2 AS level, true AS passing FROM roots WHERE id IN (SELECT id FROM symbols) UNION SELECT id, true, 2, false FROM held_seeds UNION SELECT to_id, false, {first}, {first} = 4 FROM e WHERE NOT inside AND NOT guessed {'AND NOT test' if production else ''}"
    grow = f"SELECT s.to_id, holds OR reads = 'gate', {level}, ({level}) = 4 FROM w JOIN steps s USING (node) WHERE (reads <> 'export' OR level >= 3) {'AND (holds OR NOT test)' if production else ''}"
    return ctes("symbols", "refs", "roots", "held_seeds", "gates", "exempt", *more, recursive=True) + EDGES + f", steps AS ({steps}), w(node, holds, level, passing) AS ({seeds} UNION {grow}), reached AS (SELECT node, max(level) AS level, bool_or(passing) AS passing FROM w GROUP BY node)"


def _sweep(spark, sf, gates=False, production=True):
    names = ("symbols", "refs", "roots", "held_seeds")
    return liveness.sweep_reach(*[fact(spark, sf, n) for n in names], fact(spark, sf, "gates") if gates else None, production)


@query(ctes("symbols", "refs", "roots", recursive=True) + ", w(node) AS (SELECT id FROM roots UNION SELECT to_id FROM w JOIN refs ON from_id = node WHERE NOT guessed) SELECT node FROM w")
def reach_simple(spark, sf):
    return reach(fact(spark, sf, "refs").where("not guessed"), fact(spark, sf, "roots").select(F.col("id").alias("node"))).select("node")


@query(ctes("refs", "roots", recursive=True) + ", w(node, depth) AS (SELECT id, 0 FROM roots UNION SELECT to_id, depth + 1 FROM w JOIN refs ON from_id = node WHERE NOT guessed AND depth < 40) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def shortest_path_depth(spark, sf):
    return reach(fact(spark, sf, "refs").where("not guessed"), fact(spark, sf, "roots").select(F.col("id").alias("node")))


@query(walk_sql() + " SELECT node, level, passing FROM reached")
def reach_levels(spark, sf):
    return _sweep(spark, sf).select("node", "level", "passing")


# The same walk over merged declarations: a whole read of one of them enters what all of them export.
_GROUPS = "gr AS (SELECT id, parent, ref, block FROM symbols WHERE kind IN ('class', 'enum', 'function') OR block = 'value'), sp AS (SELECT DISTINCT parent, ref FROM gr WHERE block = 'value'), wr AS (SELECT c.parent AS id, c.id AS child FROM symbols c JOIN symbols h ON c.parent = h.id WHERE c.exported AND (h.kind = 'file' OR h.block = 'module') UNION SELECT g.id, c.id FROM symbols c JOIN symbols h ON c.parent = h.id JOIN sp ON sp.parent = h.parent AND sp.ref = h.ref JOIN gr g ON g.parent = h.parent AND g.ref = h.ref WHERE h.kind <> 'file' AND coalesce(h.block, '') <> 'module' AND ((h.block = 'value' AND c.exported) OR (h.kind = 'class' AND c.is_static) OR (h.kind = 'enum' AND c.kind = 'enum-member')))"
_STEP = "CASE WHEN reads = 'export' THEN level WHEN reads = 'passes' THEN CASE WHEN passing THEN 4 WHEN level >= 2 THEN 3 ELSE 1 END WHEN reads = 'whole' THEN 3 ELSE 1 END"


@query(
    ctes("modules", "module_refs", "module_roots", recursive=True)
    + f", symbols AS (SELECT * FROM modules), refs AS (SELECT * FROM module_refs){EDGES}, {_GROUPS}, steps AS (SELECT from_id AS node, to_id, reads, test FROM e WHERE inside UNION SELECT id, child, 'export', false FROM wr)"
    + f", w(node, level, passing) AS (SELECT id, 2, true FROM module_roots UNION SELECT s.to_id, {_STEP}, ({_STEP}) = 4 FROM w JOIN steps s USING (node) WHERE (reads <> 'export' OR level >= 3) AND NOT test) SELECT node, max(level) AS level, bool_or(passing) AS passing FROM w GROUP BY node"
)
def reach_of_groups(spark, sf):
    return liveness.sweep_reach(fact(spark, sf, "modules"), fact(spark, sf, "module_refs"), fact(spark, sf, "module_roots"), fact(spark, sf, "module_roots").limit(0)).select("node", "level", "passing")


@query(walk_sql(gates=True) + " SELECT node, level, passing FROM reached")
def gated_reach(spark, sf):
    return _sweep(spark, sf, gates=True).select("node", "level", "passing")


@query(walk_sql(production=False) + " SELECT node, level FROM reached")
def reach_tests(spark, sf):
    return _sweep(spark, sf, production=False).select("node", "level")


JUDGED = walk_sql("suppressions", "edge_sides") + ", counts AS (SELECT to_id AS id, count(*) FILTER (WHERE NOT guessed AND NOT test) AS production, count(*) FILTER (WHERE NOT guessed AND test) AS test FROM refs WHERE to_id IN (SELECT id FROM symbols) GROUP BY to_id), judged AS (SELECT s.*, coalesce(production, 0) AS production, coalesce(test, 0) AS test, (s.id IN (SELECT id FROM roots WHERE kind <> 'published-api') OR coalesce(production, 0) > 0 OR coalesce(level, 0) = 4) AS live_counting, level IS NOT NULL AS live_reach, s.kind <> 'file' AND s.id NOT IN (SELECT id FROM exempt) AND NOT ((s.id IN (SELECT id FROM roots WHERE kind <> 'published-api') OR coalesce(production, 0) > 0 OR coalesce(level, 0) = 4) AND level IS NOT NULL) AS dead, CASE WHEN coalesce(production, 0) = 0 THEN 'reference-counting' ELSE 'reachability' END AS relation FROM symbols s LEFT JOIN counts USING (id) LEFT JOIN reached ON s.id = node)"


def _judged(spark, sf):
    return liveness.judge(*[fact(spark, sf, n) for n in ("symbols", "refs", "roots", "held_seeds", "exempt")])


def _coded(spark, sf):
    judged = cut(_judged(spark, sf))
    inside = judged.where("dead").select(F.col("id").alias("parent"), F.lit(True).alias("container_dead"))
    rows = judged.where("dead").join(inside, "parent", "left").withColumn("deprecated", F.col("line") % 10 == 0)
    return codes.with_flags(rows).withColumn("code", codes.code_of_dead()).where("code is not null")


# Of a dead container the container alone is reported, but for an interface, whose own rule says so. Deprecation comes before use by tests.
CODED = JUDGED + ", coded AS (SELECT *, CASE WHEN kind = 'interface' THEN 'DS1201' WHEN parent IN (SELECT id FROM judged WHERE dead) THEN NULL WHEN production = 0 AND line % 10 = 0 THEN 'DS1104' WHEN test > 0 AND production = 0 THEN 'DS1102' WHEN exported THEN 'DS1001' ELSE 'DS1002' END AS code FROM judged WHERE dead)"


@query(CODED + " SELECT code, id, kind, path, line, relation FROM coded WHERE code IS NOT NULL")
def dead_symbols(spark, sf):
    return _coded(spark, sf).select("code", "id", "kind", "path", "line", "relation")


@query(CODED + " SELECT code, kind, relation, count(*) AS n FROM coded WHERE code IS NOT NULL GROUP BY ALL")
def codes_dead(spark, sf):
    return _coded(spark, sf).groupBy("code", "kind", "relation").agg(F.count("*").alias("n"))


@query(walk_sql(gates=True) + ", counts AS (SELECT to_id AS id, count(*) FILTER (WHERE NOT guessed AND NOT test) AS production FROM refs GROUP BY to_id), kept AS (SELECT id FROM exempt UNION SELECT g.id FROM gates g WHERE g.file IN (SELECT node FROM reached)) SELECT s.id, s.kind FROM symbols s LEFT JOIN counts c USING (id) LEFT JOIN reached r ON r.node = s.id WHERE s.kind <> 'file' AND s.id NOT IN (SELECT id FROM kept) AND NOT ((s.id IN (SELECT id FROM roots WHERE kind <> 'published-api') OR coalesce(production, 0) > 0 OR coalesce(level, 0) = 4) AND level IS NOT NULL)")
def dead_with_gates(spark, sf):
    names = ("symbols", "refs", "roots", "held_seeds", "exempt", "gates")
    return liveness.judge(*[fact(spark, sf, n) for n in names]).where("dead").select("id", "kind")


def _narrowed(spark, sf, closed):
    symbols, roots = fact(spark, sf, "symbols"), fact(spark, sf, "roots")
    live = _judged(spark, sf).where("not dead and kind <> 'file'").drop("kind", "path")
    rows = live.join(edges.visibility_reach(fact(spark, sf, "refs"), symbols), "id").join(codes.entered(symbols, roots), "id").join(symbols.select("id", "kind", "path"), "id")
    holders = symbols.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"))
    rows = rows.join(holders, "parent").withColumns({"written": F.lit(False), "exposed": F.lit(False)})
    return rows.withColumn("code", codes.code_of_live(closed)).where("code is not null").select("id", "code")


LIVE = JUDGED + ", pub AS (SELECT id FROM roots WHERE kind = 'published-api'), scope AS (SELECT to_id AS id, max(CASE WHEN consumer <> '' THEN 2 WHEN r.path <> s.path THEN 1 ELSE 0 END) AS r FROM refs r JOIN symbols s ON r.to_id = s.id GROUP BY to_id), ex AS (SELECT j.id, r, j.path IN (SELECT path FROM symbols WHERE id IN (SELECT id FROM pub)) AS file_published FROM judged j JOIN scope USING (id) JOIN symbols p ON p.id = j.parent AND p.kind = 'file' WHERE NOT dead AND j.kind <> 'file' AND j.exported AND j.id NOT IN (SELECT id FROM roots WHERE kind = 'configured'))"


@query(LIVE + " SELECT id, 'DS1503' AS code FROM ex WHERE r = 0 AND NOT file_published")
def codes_live(spark, sf):
    return _narrowed(spark, sf, False)


@query(LIVE + " SELECT id, 'DS1503' AS code FROM ex WHERE r = 0 UNION ALL SELECT id, 'DS1501' FROM ex WHERE r = 1 AND id IN (SELECT id FROM pub)")
def codes_live_in_a_closed_world(spark, sf):
    return _narrowed(spark, sf, True)


@query(JUDGED + ", tc AS (SELECT id FROM symbols WHERE kind = 'function' AND line % 3 = 0), sup AS (SELECT id FROM symbols WHERE kind = 'class'), t AS (SELECT DISTINCT from_id, to_id FROM refs WHERE from_id IN (SELECT id FROM tc)), g AS (SELECT from_id, bool_and(to_id IN (SELECT id FROM judged WHERE dead)) AS all_dead FROM t WHERE to_id IN (SELECT id FROM symbols WHERE kind = 'variable') GROUP BY from_id), sh AS (SELECT DISTINCT to_id FROM t JOIN g USING (from_id) WHERE NOT all_dead AND to_id IN (SELECT id FROM sup)) SELECT from_id AS id FROM g WHERE all_dead AND from_id NOT IN (SELECT from_id FROM t WHERE to_id IN (SELECT to_id FROM sh))")
def test_of_dead_code(spark, sf):
    symbols, refs = fact(spark, sf, "symbols"), fact(spark, sf, "refs").select("from_id", "to_id")
    support = symbols.where("kind = 'class'").select("id")
    code = symbols.where("kind = 'function' and line % 3 = 0").select("id")
    edges_ = refs.join(code.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return liveness.tests_of_dead_code(edges_, code.unionByName(support), support, _judged(spark, sf).where("dead").select("id"), symbols.where("kind in ('variable', 'class')").select("id"))


@query(JUDGED + ", tc AS (SELECT id FROM symbols WHERE kind = 'function' AND line % 3 = 0) SELECT DISTINCT to_id AS id FROM refs WHERE test AND from_id IN (SELECT id FROM tc) AND from_id IN (SELECT node FROM reached) AND from_id NOT IN (SELECT id FROM exempt)")
def kept_by_tests(spark, sf):
    symbols = fact(spark, sf, "symbols").where("kind = 'function' and line % 3 = 0").select("id")
    reached = symbols.join(_sweep(spark, sf).select(F.col("node").alias("id")), "id", "left_semi")
    return liveness.kept_by_tests(fact(spark, sf, "refs"), reached, fact(spark, sf, "exempt"))


@query(JUDGED + ", u(id) AS (SELECT id FROM judged WHERE kind = 'function' AND line % 7 = 0 UNION SELECT r.to_id FROM u JOIN refs r ON r.from_id = u.id WHERE r.to_id IN (SELECT id FROM judged WHERE dead)) SELECT id FROM u WHERE id IN (SELECT id FROM judged WHERE dead)")
def test_used_reach(spark, sf):
    judged = cut(_judged(spark, sf))
    return liveness.test_used_reach(fact(spark, sf, "refs"), judged.where("kind = 'function' and line % 7 = 0").select("id"), judged.where("dead").select("id"))


@query(JUDGED + " SELECT j.id, j.kind, CASE WHEN w1 THEN 'holding' ELSE 'normal' END AS tier FROM judged j JOIN (SELECT node, bool_or(holds) AS w1 FROM w GROUP BY node) ON node = j.id WHERE NOT j.dead")
def explain_live(spark, sf):
    reached = cut(_sweep(spark, sf))
    judged = liveness.judge(*[fact(spark, sf, n) for n in ("symbols", "refs", "roots", "held_seeds", "exempt")], reached=reached)
    tiers = reached.select(F.col("node").alias("id"), F.when(F.col("holds"), "holding").otherwise("normal").alias("tier"))
    return judged.where("not dead").select("id", "kind").join(tiers, "id")


@query(ctes("symbols", "exempt") + " SELECT s.path, s.line, s.id FROM symbols s JOIN exempt USING (id)")
def retained(spark, sf):
    return fact(spark, sf, "symbols").join(fact(spark, sf, "exempt"), "id").select("path", "line", "id")


@query(ctes("symbols", "roots") + " SELECT r.kind, s.path, s.line, s.id FROM roots r JOIN symbols s USING (id)")
def print_roots(spark, sf):
    return fact(spark, sf, "roots").select("id", F.col("kind").alias("root_kind")).join(fact(spark, sf, "symbols"), "id").select(F.col("root_kind").alias("kind"), "path", "line", "id")


# --- components -----------------------------------------------------------------------------------------------------

CLOSURE = ctes("refs", recursive=True) + ", pe AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM refs), nodes AS (SELECT src AS node FROM pe UNION SELECT dst FROM pe), t(a, b) AS (SELECT src, dst FROM pe UNION SELECT t.a, pe.dst FROM t JOIN pe ON t.b = pe.src), scc AS (SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS scc FROM nodes n LEFT JOIN (SELECT p.a, p.b FROM t p JOIN t q ON p.a = q.b AND p.b = q.a) x ON x.a = n.node GROUP BY n.node)"


def _cyclic(spark, sf):
    return fact(spark, sf, "refs").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


@query(ctes("refs", recursive=True) + ", ue AS (SELECT from_id AS a, to_id AS b FROM refs UNION SELECT to_id, from_id FROM refs), cc(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM ue GROUP BY a UNION (SELECT p.node, min(n.root) FROM recurring.cc p JOIN ue ON ue.a = p.node JOIN cc n ON n.node = ue.b WHERE n.root < p.root GROUP BY p.node)) SELECT node, root FROM cc")
def weak_components_of_symbols(spark, sf):
    return weak_components(_cyclic(spark, sf))


@query(CLOSURE + " SELECT node, scc FROM scc")
def strong_components_of_symbols(spark, sf):
    return strong_components(_cyclic(spark, sf))


@query(CLOSURE + " SELECT DISTINCT b.scc FROM pe JOIN scc a ON pe.src = a.node JOIN scc b ON pe.dst = b.node WHERE a.scc <> b.scc")
def referenced_cycles_of_symbols(spark, sf):
    e = _cyclic(spark, sf)
    return referenced_cycles(e, cut(strong_components(e)))


@query()  # strong components by closure take SQL a minute and more
def component_summary(spark, sf):
    rows = liveness.numbered(cut(liveness.components(_judged(spark, sf), fact(spark, sf, "refs"))))
    return rows.groupBy("component_id", "component").agg(F.count("*").alias("members"), F.count_if("root").alias("roots"), F.max("lines").alias("lines"))


@query(ctes("symbols") + ", r AS (SELECT parent, path, line, end_line, max(end_line) OVER (PARTITION BY parent, path ORDER BY line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM symbols WHERE parent <> '') SELECT parent, CAST(sum(greatest(0, end_line - greatest(line - 1, coalesce(p, 0)))) AS BIGINT) AS lines FROM r GROUP BY parent")
def lines_spanned(spark, sf):
    return joins.gap_and_island_lines(fact(spark, sf, "symbols").where("parent <> ''"), ["parent"])


# --- greatest fixpoints and closures --------------------------------------------------------------------------------


@query(ctes("file_uses", "test_files", "root_files", recursive=True) + ", t(path) AS (SELECT path FROM test_files UNION SELECT to_path FROM t JOIN file_uses ON from_path = path), cand AS (SELECT path FROM t WHERE path NOT IN (SELECT path FROM test_files) AND path NOT IN (SELECT path FROM root_files)), bad(path) AS (SELECT to_path FROM file_uses WHERE to_path IN (SELECT path FROM cand) AND from_path NOT IN (SELECT path FROM test_files) AND from_path NOT IN (SELECT path FROM cand) UNION SELECT to_path FROM bad JOIN file_uses ON from_path = path WHERE to_path IN (SELECT path FROM cand)) SELECT path, true AS support FROM cand WHERE path NOT IN (SELECT path FROM bad)")
def support_of_tests(spark, sf):
    return support_files(fact(spark, sf, "file_uses"), fact(spark, sf, "test_files"), fact(spark, sf, "root_files"))


@query(ctes("file_uses", "root_files", recursive=True) + ", k(path) AS (SELECT path FROM root_files UNION SELECT to_path FROM k JOIN file_uses ON from_path = path) SELECT path FROM k")
def kept_files(spark, sf):
    return reach(fact(spark, sf, "file_uses"), fact(spark, sf, "root_files").select(F.col("path").alias("node")), "from_path", "to_path").select(F.col("node").alias("path"))


@query(ctes("file_uses", "root_files", "symbols", recursive=True) + ", k(path) AS (SELECT path FROM root_files UNION SELECT to_path FROM k JOIN file_uses ON from_path = path) SELECT DISTINCT path FROM symbols WHERE path NOT IN (SELECT path FROM k)")
def files_never_imported(spark, sf):
    return fact(spark, sf, "symbols").select("path").distinct().join(kept_files(spark, sf), "path", "left_anti")


@query(ctes("carriers", "roots", recursive=True) + ", k(id) AS (SELECT id FROM roots WHERE kind = 'published-api' UNION SELECT carried_id FROM k JOIN carriers USING (id)) SELECT id FROM k")
def exposed_types(spark, sf):
    return reach(fact(spark, sf, "carriers"), fact(spark, sf, "roots").where("kind = 'published-api'").select(F.col("id").alias("node")), "id", "carried_id").select(F.col("node").alias("id"))


@query(
    ctes("manifests", "dir_peers", "dir_needed", recursive=True)
    + ", k(dir, name) AS (SELECT dir, name FROM dir_needed UNION SELECT m.dir, m.name FROM k JOIN dir_peers p ON p.dir = k.dir AND p.name = k.name JOIN manifests m ON m.name = p.peer AND (m.dir = '' OR m.dir = k.dir OR starts_with(k.dir, m.dir || '/'))) SELECT dir, name FROM k"
)
def peers_of_directories(spark, sf):
    return carriers.needed_with_peers(fact(spark, sf, "manifests"), fact(spark, sf, "dir_peers"), fact(spark, sf, "dir_needed"))


# References inside a member's span are the member's; nothing out of an opaque class, or of a member within one, is followed.
@query(
    ctes("symbols", "placed_refs", "roots", "members", "opaque", "schema_reads", "member_reads", recursive=True)
    + ", own AS (SELECT r.*, coalesce((SELECT arg_max(key, from_line * 100 + from_col) FROM members m WHERE m.within = r.from_id AND (r.line, r.col) >= (from_line, from_col) AND (r.line, r.col) <= (to_line, to_col)), from_id) AS owner FROM placed_refs r WHERE to_id IN (SELECT id FROM symbols))"
    + ", shut(id) AS (SELECT id FROM opaque UNION SELECT s.id FROM shut JOIN symbols s ON s.parent = shut.id), shut2 AS (SELECT id FROM shut UNION SELECT key FROM members WHERE within IN (SELECT id FROM shut)), nodes AS (SELECT id FROM symbols UNION SELECT key FROM members)"
    + ", e AS (SELECT owner AS from_id, to_id, consumer = '' AND owner IN (SELECT id FROM nodes) AS inside, CASE WHEN NOT namespace THEN 'whole' WHEN reexport THEN 'passes' ELSE 'none' END AS reads FROM own WHERE use <> 'write' AND NOT test UNION SELECT from_id, to_id, true, 'none' FROM schema_reads UNION SELECT from_id, member, true, 'none' FROM member_reads)"
    + ", steps AS (SELECT from_id AS node, to_id, reads FROM e WHERE inside AND from_id NOT IN (SELECT id FROM shut2) UNION SELECT f.id, s.id, 'export' FROM symbols s JOIN symbols f ON s.parent = f.id AND f.kind = 'file' WHERE s.exported)"
    + f", w(node, level, passing) AS (SELECT id, 2, true FROM roots UNION SELECT to_id, CASE WHEN reads = 'passes' THEN 4 WHEN reads = 'whole' THEN 3 ELSE 1 END, reads = 'passes' FROM e WHERE NOT inside AND from_id NOT IN (SELECT id FROM shut2) UNION SELECT s.to_id, {_STEP}, ({_STEP}) = 4 FROM w JOIN steps s USING (node) WHERE reads <> 'export' OR level >= 3) SELECT DISTINCT node AS id, node IN (SELECT key FROM members) AS member FROM w"
)
def carried_by_hand(spark, sf):
    symbols = fact(spark, sf, "symbols")
    return carriers.carry(symbols, fact(spark, sf, "placed_refs"), edges.whole_reads(symbols), fact(spark, sf, "roots"), *[fact(spark, sf, n) for n in ("members", "opaque", "schema_reads", "member_reads")])


@query(ctes("peers", "manifests", recursive=True) + ", k(name) AS (SELECT name FROM manifests WHERE dir = 'src' UNION SELECT peer FROM k JOIN peers USING (name)) SELECT name FROM k")
def peers_needed(spark, sf):
    return peer_closure(fact(spark, sf, "manifests").where("dir = 'src'"), fact(spark, sf, "peers"))


# --- findings -------------------------------------------------------------------------------------------------------

RANKS = "(CASE confidence WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 ELSE 3 END)"
FOUND = ctes("findings", "suppressions") + f", f0 AS (SELECT *, least({RANKS}, CASE WHEN subject_lines % 2 = 0 THEN 2 ELSE 3 END) AS own, subject_lines % 9 = 0 AS test_used FROM findings), cap AS (SELECT component, min(own) AS cap FROM f0 WHERE is_root GROUP BY component), f1 AS (SELECT f0.* EXCLUDE (confidence), CASE least(CASE WHEN test_used THEN 1 ELSE own END, coalesce(cap, 3)) WHEN 1 THEN 'possible' WHEN 2 THEN 'probable' ELSE 'certain' END AS confidence FROM f0 LEFT JOIN cap USING (component)), f2 AS (SELECT *, CASE WHEN code = 'DS1003' THEN 'allow' WHEN code = 'DS1002' THEN 'warn' ELSE 'deny' END AS severity FROM f1), f3 AS (SELECT *, severity = 'allow' OR confidence = 'possible' AS low FROM f2), found AS (SELECT f3.*, low OR component IN (SELECT component FROM f3 WHERE is_root AND low) AS withheld, CAST(subject_lines * 2 AS BIGINT) AS lines FROM f3)"


def _found(spark, sf):
    rows = fact(spark, sf, "findings").withColumns({"relation": F.when(F.col("subject_lines") % 2 == 0, "reachability").otherwise("reference-counting"), "test_used": F.col("subject_lines") % 9 == 0})
    rows = rules.withheld(rules.confidence(rows), "probable", {"DS1003": "allow", "DS1002": "warn"})
    return rows.withColumn("lines", (F.col("subject_lines") * 2).cast("long"))


@query(FOUND + " SELECT declaration, code, confidence FROM f1")
def confidence(spark, sf):
    return _found(spark, sf).select("declaration", "code", "confidence")


@query(FOUND + " SELECT declaration, severity, withheld FROM found")
def severity(spark, sf):
    return _found(spark, sf).select("declaration", "severity", "withheld")


@query(FOUND + " SELECT confidence, count(*) AS n FROM found WHERE confidence = 'possible' AND severity <> 'allow' GROUP BY confidence")
def withheld_counts(spark, sf):
    return rules.withheld_counts(_found(spark, sf), "probable")


# A record claims, in reading order, what it names and no earlier one took; what is taken is a code at a position.
LEDGER = (
    FOUND
    + ", b AS (SELECT DISTINCT mechanism, site, code, bound FROM suppressions WHERE mechanism <> 'inline' AND bound <> '')"
    + ", named AS (SELECT DISTINCT f.code, f.path, f.line, f.col, f.declaration, f.ref, f.withheld, s.record_ord FROM found f JOIN suppressions s ON s.code = f.code AND s.path = f.path WHERE CASE WHEN s.mechanism = 'inline' THEN s.bound <> '' AND s.bound = f.declaration ELSE s.symbol = f.ref AND (f.declaration = '' OR f.declaration = s.bound OR NOT EXISTS (SELECT 1 FROM b WHERE b.mechanism = s.mechanism AND b.site = s.site AND b.code = s.code AND b.bound = f.declaration)) END)"
    + ", took AS (SELECT code, path, line, col, min(record_ord) AS record_ord FROM named GROUP BY ALL), n AS (SELECT record_ord, count(*) AS claimed, bool_and(withheld) AS w FROM named JOIN took USING (code, path, line, col, record_ord) GROUP BY record_ord)"
    + ", ledger AS (SELECT s.record_ord, CASE WHEN claimed IS NULL THEN CASE WHEN bound <> '' AND (code = 'DS1003' OR bound IN (SELECT id FROM exempt)) THEN 'dormant' ELSE 'stale' END WHEN w THEN 'dormant' ELSE 'in-effect' END AS verdict, coalesce(claimed, 0) AS claimed FROM suppressions s LEFT JOIN n USING (record_ord))"
)
LEDGER = LEDGER.replace(ctes("findings", "suppressions"), ctes("findings", "suppressions", "exempt"), 1)


def _ledger(spark, sf):
    return rules.ledger(_found(spark, sf), fact(spark, sf, "suppressions"), ["DS1003"], fact(spark, sf, "exempt"))


@query(LEDGER + " SELECT record_ord, verdict, claimed FROM ledger")
def ledger_verdicts(spark, sf):
    return _ledger(spark, sf)


@query(LEDGER + ", e AS (SELECT site, mechanism, symbol, code, bool_and(verdict = 'stale') AS stale FROM suppressions JOIN ledger USING (record_ord) GROUP BY ALL) SELECT site, mechanism, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM e WHERE stale GROUP BY site, mechanism")
def stale_suppressions(spark, sf):
    return rules.stale_sites(_ledger(spark, sf), fact(spark, sf, "suppressions"))


@query(FOUND + ", held AS (SELECT DISTINCT code, symbol AS ref, path FROM suppressions WHERE mechanism = 'baseline') SELECT DISTINCT code, ref, path FROM found WHERE NOT withheld AND code NOT LIKE 'DS9%'")
def baseline_rows(spark, sf):
    held = fact(spark, sf, "suppressions").where("mechanism = 'baseline'").select("code", F.col("symbol").alias("ref"), "path")
    return rules.baseline_fixpoint(_found(spark, sf), held)


@query(FOUND + " SELECT code, severity, CAST(sum(n) AS BIGINT) AS findings, count(*) AS components, CAST(sum(l) AS BIGINT) AS lines FROM (SELECT code, severity, component, count(*) AS n, max(lines) AS l FROM found WHERE NOT withheld GROUP BY ALL) GROUP BY ALL")
def report_totals(spark, sf):
    return rules.totals(_found(spark, sf))


@query(FOUND + " SELECT CAST(sum(l) AS BIGINT) AS lines FROM (SELECT component, max(lines) AS l FROM found WHERE NOT withheld GROUP BY component)")
def deletable_lines(spark, sf):
    return rules.deletable_lines(_found(spark, sf))


@query(FOUND + " SELECT path, line, code, ref, lines FROM found WHERE NOT withheld ORDER BY lines DESC, subject_lines DESC, path, line, col, code, ref")
def sorted_findings(spark, sf):
    return rules.ordered(_found(spark, sf).where("not withheld"), "size").select("path", "line", "code", "ref", "lines")


@query(FOUND + " SELECT * FROM (SELECT row_number() OVER (ORDER BY lines DESC, subject_lines DESC, path, line, col, code, ref) AS place, path, line, code, ref FROM found WHERE NOT withheld) WHERE place <= 25")
def top_findings(spark, sf):
    return rules.top(_found(spark, sf).where("not withheld"), 25).select("place", "path", "line", "code", "ref")


@query(FOUND + " SELECT path || ':' || line || ':' || col || ': ' || code || ' ' || ref || ' (' || severity || ', ' || confidence || ')' AS text FROM found WHERE NOT withheld")
def text_lines(spark, sf):
    return _found(spark, sf).where("not withheld").select(rules.text_line().alias("text"))


@query(FOUND + " SELECT '::' || CASE severity WHEN 'deny' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END || ' file=' || replace(replace(replace(path, '%', '%25'), ':', '%3A'), ',', '%2C') || ',line=' || line || ',title=' || code || '::' || replace(ref, '%', '%25') AS text FROM found WHERE NOT withheld")
def annotation_lines(spark, sf):
    return _found(spark, sf).where("not withheld").select(rules.annotation_line().alias("text"))


@query()
def sarif_log(spark, sf):
    found = cut(_found(spark, sf).where("not withheld"))
    return rules.sarif(found, -(-found.count() // SARIF_PIECE))


@query(ctes("findings") + " SELECT declaration, sha256(code || chr(10) || ref) AS fingerprint FROM findings")
def symbol_fingerprint(spark, sf):
    return fact(spark, sf, "findings").select("declaration", text.symbol_fingerprint("code", "ref").alias("fingerprint"))


# --- dependencies, parts, edges between languages -------------------------------------------------------------------

NEEDS = ", needs AS (SELECT f.name, f.owner, arg_max(m.dir, length(m.dir)) AS \"at\" FROM dep_files f JOIN (SELECT DISTINCT * FROM manifests) m ON m.name = f.name AND (m.dir = '' OR f.dir = m.dir OR starts_with(f.dir, m.dir || '/')) GROUP BY f.dir, f.name, f.owner)"


@query(JUDGED.replace("WITH RECURSIVE ", ctes("dep_files", "manifests", recursive=True) + NEEDS + ", ", 1) + " SELECT d.dir, d.name, CASE WHEN n.name IS NULL THEN 'unused' ELSE 'dead' END AS state FROM (SELECT DISTINCT * FROM manifests) d LEFT JOIN (SELECT \"at\", needs.name, bool_and(j.id IS NOT NULL) AS all_dead FROM needs LEFT JOIN (SELECT id FROM judged WHERE dead) j ON j.id = owner GROUP BY ALL) n ON n.\"at\" = d.dir AND n.name = d.name WHERE d.name <> 'pkg1' AND (n.name IS NULL OR all_dead)")
def unused_dependencies(spark, sf):
    needs = joins.nearest_ancestor(fact(spark, sf, "dep_files"), fact(spark, sf, "manifests"))
    ran = spark.createDataFrame([("pkg1",)], "name string")
    return rules.unused_dependencies(fact(spark, sf, "manifests"), needs, ran, _judged(spark, sf).where("dead"))


@query(ctes("dep_files", "manifests") + NEEDS + ' SELECT "at", name, min(owner) AS owner FROM needs GROUP BY "at", name HAVING count(DISTINCT owner) = 1')
def last_uses(spark, sf):
    return rules.last_uses(joins.nearest_ancestor(fact(spark, sf, "dep_files"), fact(spark, sf, "manifests")))


@query(ctes("parts_found", "parts_judging") + " SELECT declaration, name, f = j AS stands FROM (SELECT declaration, name, count(DISTINCT configuration) AS f FROM parts_found GROUP BY ALL) JOIN (SELECT declaration, count(*) AS j FROM parts_judging GROUP BY ALL) USING (declaration)")
def parts_all_judges(spark, sf):
    return rules.part_verdicts(fact(spark, sf, "parts_found"), fact(spark, sf, "parts_judging"))


@query(ctes("parts_found") + " SELECT declaration, name FROM parts_found GROUP BY ALL HAVING NOT bool_or(in_use)")
def unused_imports(spark, sf):
    return rules.unused_imports(fact(spark, sf, "parts_found"))


@query(JUDGED + " SELECT edge, CASE WHEN count(*) FILTER (WHERE NOT dead) > 0 THEN 'live' WHEN count(*) FILTER (WHERE dead IS NULL) = count(*) THEN 'absent' ELSE 'dead' END AS state, count(*) FILTER (WHERE NOT dead) AS live, count(*) FILTER (WHERE dead IS NULL) AS absent FROM edge_sides e LEFT JOIN judged j ON e.symbol = j.id GROUP BY edge")
def edge_evaluations(spark, sf):
    return rules.edge_evaluations(fact(spark, sf, "edge_sides"), _judged(spark, sf))


# --- functions ------------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/+$', '') AS path FROM pages")
def path_normalize(spark, sf):
    stripped = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), F.when(stripped == "", "").otherwise(paths.normalized(stripped)).alias("path"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<script>')) FROM pages) GROUP BY page_id")
def html_entries(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(text.html_entries_udf(F.replace("html", F.lit("<script>"), F.lit('<script src="/track.js">')))).alias("src"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(len(json_keys(props)) AS INT) AS members FROM events WHERE json_valid(props)")
def json_members(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$").isNotNull()).select("event_id", F.size(F.json_object_keys("props")).alias("members"))


@query("SELECT event_id, t.atom ->> '$' AS value FROM events e LEFT JOIN LATERAL (SELECT * FROM json_tree(e.props) WHERE type = 'VARCHAR') t ON true")
def json_strings(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode_outer(text.json_strings_udf("props")).alias("value"))


#: Units after the text: one of 65535, then zeros. Powers of 37 modulo 2^64.
LINE_HASHES = """
WITH RECURSIVE p(k, v) AS (SELECT 99, 1::HUGEINT UNION ALL SELECT k - 1, (v * 37) % 18446744073709551616::HUGEINT FROM p WHERE k > 0),
t AS (SELECT item_id, replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ', ''), chr(9), '') AS c FROM benchmark),
u AS (SELECT item_id, CASE WHEN c = '' THEN [65535] ELSE list_concat(list_transform(string_split(c, ''), lambda x: unicode(x)), [65535]) END AS us FROM t),
s AS (SELECT item_id, us, 0 AS pos, 0 AS line FROM u UNION ALL SELECT item_id, us, i, row_number() OVER (PARTITION BY item_id ORDER BY i) FROM (SELECT item_id, us, unnest(range(1, len(us))) AS i FROM u) WHERE us[i] = 10),
h AS (SELECT item_id, line, sum(coalesce(us[pos + k + 1], 0)::HUGEINT * v) % 18446744073709551616::HUGEINT AS x FROM s, p GROUP BY item_id, line)
SELECT item_id, line::INT AS line, lower(hex(x::UBIGINT)) || ':' || row_number() OVER (PARTITION BY item_id, x ORDER BY line) AS hash FROM h"""


@query(LINE_HASHES)
def line_hashes(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(text.line_hashes_udf("text")).alias("line", "hash"))


@query("SELECT p_partkey, p_size > 10 OR (p_size = 10 AND p_partkey % 7 >= 3) OR p_size = 2 AS ok FROM part")
def semver_satisfies(spark, sf):
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".0"))
    return table(spark, sf, "part").select("p_partkey", semver.satisfies_udf(version, F.lit(">=10.3.0 || ^2.0.0")).alias("ok"))


# --- sources --------------------------------------------------------------------------------------------------------


@query(ctes("paths") + r" SELECT path, regexp_matches(path, '^lib/') OR (regexp_matches(path, '^app/m[^/]*\.ts$') AND path <> 'app/m7.ts') AS ignored FROM paths")
def ignored_paths(spark, sf):
    return tree.ignored(fact(spark, sf, "paths"), ["# built", "lib/", "app/m*.ts", "!m7.ts", ""])


@query(ctes("paths") + r" SELECT path, 'test' AS class FROM paths WHERE regexp_matches(path, '^app/m[0-9]\.ts$') UNION ALL SELECT path, 'generated' FROM paths WHERE regexp_matches(path, '^lib/') UNION ALL SELECT path, 'component' FROM paths WHERE regexp_matches(path, 'Brand#1[^/]\.ts$')")
def classed_files(spark, sf):
    return tree.classed(fact(spark, sf, "paths"), {"test": ["app/m?.ts"], "generated": ["lib/**"], "component": ["**/Brand#1?.ts"]})


@query(ctes("paths") + r" SELECT 'app/*.ts' AS pattern, count(*) FILTER (WHERE regexp_matches(path, '^app/')) AS files FROM paths UNION ALL SELECT 'none/**', 0")
def rule_hits(spark, sf):
    return tree.rule_hits(fact(spark, sf, "paths"), ["app/*.ts", "none/**"])


@query(ctes("manifest_docs") + ", j AS (SELECT replace(path, '/package.json', '') AS dir, text FROM manifest_docs) SELECT dir, k AS name, section, json_extract_string(text, '$.' || section || '.\"' || k || '\"') AS range FROM (SELECT dir, text, s AS section, unnest(json_keys(text, '$.' || s)) AS k FROM j, (VALUES ('dependencies'), ('devDependencies')) v(s))")
def declared_dependencies(spark, sf):
    return manifests.declared(manifests.manifests(fact(spark, sf, "manifest_docs")))


@query("SELECT concat('src/n', n_nationkey) AS dir, 'manifest-entry' AS kind, concat('src/n', n_nationkey, '/lib/main.ts') AS target FROM nation UNION ALL SELECT concat('src/n', n_nationkey), 'manifest-binary', concat('src/n', n_nationkey, '/bin/run', n_nationkey, '.js') FROM nation")
def manifest_entries(spark, sf):
    return manifests.entry_points(manifests.manifests(fact(spark, sf, "manifest_docs")))


@query("SELECT concat('src/n', n_nationkey) AS dir, script, tool, k AS word_ord, word FROM nation, (VALUES ('build', 'tsc', 0, 'tsc'), ('build', 'tsc', 1, '-p'), ('build', 'tsc', 2, ''), ('build', 'node', 0, 'node'), ('build', 'node', 1, './lib/main.ts'), ('test', 'vitest', 0, 'vitest'), ('test', 'vitest', 1, 'run')) v(script, tool, k, w), LATERAL (SELECT CASE WHEN w = '' THEN concat('src/n', n_nationkey, '.ts') ELSE w END AS word)")
def script_words(spark, sf):
    return manifests.commands(manifests.manifests(fact(spark, sf, "manifest_docs")))


@query("SELECT DISTINCT concat('src/n', n_nationkey) AS dir, w AS word, w AS name FROM nation, (VALUES ('tsc'), ('vitest')) v(w)")
def packages_run(spark, sf):
    read = manifests.manifests(fact(spark, sf, "manifest_docs"))
    return manifests.words_to_packages(manifests.commands(read), manifests.declared(read))


@query("SELECT concat('src/n', n_nationkey) AS dir, concat('src/n', n_nationkey, '.ts') AS word, concat('src/n', n_nationkey, '.ts') AS path FROM nation")
def files_named(spark, sf):
    words = manifests.commands(manifests.manifests(fact(spark, sf, "manifest_docs"))).select(F.lit("").alias("top"), "dir", "word")
    found = manifests.words_to_files(words.select(F.col("top").alias("dir"), "word").distinct(), fact(spark, sf, "paths"))
    return found.join(words.select("dir", "word").distinct().withColumnRenamed("dir", "from_dir"), "word").select(F.col("from_dir").alias("dir"), "word", "path")


@query(ctes("paths") + r" SELECT path, 'runner' AS tool, 'test' AS class FROM paths WHERE path LIKE 'app/m1%.ts'")
def convention_files(spark, sf):
    declared = spark.createDataFrame([("", "runner", "2.4.1"), ("", "old", "0.9.0")], "dir string, name string, version string")
    table_ = spark.createDataFrame([("runner", "runner", "^2.0.0", "test", "app/m1*.ts"), ("runner", "runner", ">=3", "entry", "lib/**"), ("old", "old", "^1.0.0", "entry", "src/**")], "tool string, package string, range string, class string, glob string")
    return conventions.convention_files(fact(spark, sf, "paths"), declared, table_).select("path", "tool", "class")


_BEFORE = "line_of AS (SELECT path, name, section, range, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) + 1 + CASE WHEN contains(before, chr(128512)) AND NOT contains(substr(before, strpos(before, chr(128512))), chr(10)) THEN 1 ELSE 0 END AS col FROM d)"


@query(
    ctes("json_docs")
    + """, c AS (SELECT d.path, d.text, c_custkey, c_nationkey FROM json_docs d JOIN customer ON d.path = 'pk' || c_custkey || '/package.json' WHERE c_custkey % 11 <> 0),
    n AS (SELECT path, text, 'dep' || (c_custkey % 40) AS name, 'dependencies' AS section, '^1.' || c_custkey || '.0' AS range FROM c UNION ALL SELECT path, text, '@s/lib' || c_nationkey, 'dependencies', '*' FROM c UNION ALL SELECT path, text, 'dev' || c_nationkey, 'devDependencies', '~2' FROM c),
    d AS (SELECT *, substr(text, 1, strpos(text, '"' || name || '"') - 1) AS before FROM n), """
    + _BEFORE
    + " SELECT path, name, section, range, CAST(line AS INT) AS line, CAST(col AS INT) AS col FROM line_of"
)
def declared_sites(spark, sf):
    return manifests.declared_sites(fact(spark, sf, "json_docs"))


@query(
    ctes("json_docs")
    + """, d AS (SELECT d.path, '' AS name, '' AS section, '' AS range, substr(d.text, 1, strpos(d.text, '"~2"') - 1) AS before FROM json_docs d JOIN customer ON d.path = 'pk' || c_custkey || '/package.json' WHERE c_custkey % 11 = 0), """
    + _BEFORE
    + " SELECT path, CAST(line AS INT) AS line, CAST(col AS INT) AS col, 'a colon is expected' AS message FROM line_of"
)
def json_faults(spark, sf):
    return manifests.json_faults(fact(spark, sf, "json_docs"))


@query(
    ctes("glob_rows", "paths")
    + r""" SELECT path, pattern FROM paths JOIN glob_rows ON CASE shape
        WHEN 0 THEN path = 'app/m' || k || '.ts' WHEN 1 THEN path = 'l' || k || '.ts' OR path = 'l' || k || '.tsx' OR path LIKE '%/l' || k || '.ts' OR path LIKE '%/l' || k || '.tsx'
        WHEN 2 THEN path IN ('app/l' || k || '.ts', 'app/m' || k || '.ts') WHEN 3 THEN regexp_matches(path, '^(app|src)/[^/]*' || k || '[.][^/]*$') WHEN 4 THEN regexp_matches(path, '^src/(.*/)?n' || k || '[^/]*$')
        ELSE regexp_matches(path, '^lib/[^/]*#' || (k % 10) || '[^/]*$') END"""
)
def glob_index(spark, sf):
    return patterns.matched(fact(spark, sf, "paths"), fact(spark, sf, "glob_rows").select("base", "glob", "pattern")).select("path", "pattern")


_NEXT = "regexp_matches(rest, '^(src/)?app/(.*/)?(layout|page|loading|not-found|error|route|template|default|forbidden|unauthorized)[.](js|jsx|ts|tsx)$') OR regexp_matches(rest, '^(src/)?pages/(.*/)?[^/]*[.](js|jsx|ts|tsx)$')"
_ASTRO = "regexp_matches(rest, '^src/pages/(.*/)?[^/]*[.](astro|js|ts)$') AND NOT regexp_matches(rest, '^src/pages/(.*/)?_[^/]*$') AND NOT regexp_matches(rest, '^src/pages/(.*/)?_[^/]*/.*$')"


@query(
    ctes("tool_files", "installed_tools")
    + f""", j AS (SELECT DISTINCT path, dir, name, CAST(split_part(version, '.', 1) AS INT) AS major, CAST(split_part(version, '.', 2) AS INT) AS minor, substr(path, length(dir) + 2) AS rest FROM tool_files JOIN installed_tools ON starts_with(path, dir || '/'))
    SELECT path, dir AS base, name AS tool, 'entry' AS class FROM j WHERE CASE name WHEN 'next' THEN (major > 13 AND major < 17 OR major = 13 AND minor >= 4) AND ({_NEXT}) WHEN 'astro' THEN major BETWEEN 5 AND 7 AND {_ASTRO}
        WHEN 'nuxt' THEN major BETWEEN 3 AND 4 AND regexp_matches(rest, '^(app/)?pages/(.*/)?[^/]*[.](vue|js|jsx|ts|tsx)$') ELSE false END
    UNION ALL SELECT path, dir, 'jest', 'test' FROM j WHERE name = 'jest' AND major BETWEEN 29 AND 30 AND regexp_matches(rest, '^(.*/)?__tests__/(.*/)?[^/]*[.](js|jsx|ts|tsx)$|^(.*/)?([^/]*[.])?(spec|test)[.](js|jsx|ts|tsx)$')
    UNION ALL SELECT path, dir, 'next', 'generated' FROM j WHERE name = 'next' AND (major > 13 AND major < 17 OR major = 13 AND minor >= 4) AND starts_with(rest, '.next/')"""
)
def framework_files(spark, sf):
    return conventions.convention_files(fact(spark, sf, "tool_files"), fact(spark, sf, "installed_tools"), conventions.table_of(spark))


@query(r"SELECT doc_id, n_chars > 0 AND text LIKE '%License%' AS licensed FROM documents WHERE regexp_matches(text, '(?i)license')")
def license_marks(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike("(?i)license")).select("doc_id", ((F.col("n_chars") > 0) & F.col("text").contains("License")).alias("licensed"))


# --- exemptions -----------------------------------------------------------------------------------------------------

SETTLED = ctes("exempt_records", "store_refs") + ", keep AS (SELECT * FROM exempt_records WHERE visibility <> 'private' OR class IN ('generated-file', 'decorator'))"


@query(SETTLED + " SELECT exempt_ord, id, class FROM keep")
def retainable_records(spark, sf):
    records = fact(spark, sf, "exempt_records")
    return exemptions.retainable(records.drop("visibility"), records.select("id", "visibility")).select("exempt_ord", "id", "class")


@query(SETTLED + " SELECT exempt_ord, id, class FROM exempt_records WHERE (while_live IS NULL OR while_live IN (SELECT concat('p', p_partkey) FROM part WHERE p_size < 25)) AND (NOT while_written OR id IN (SELECT concat('p', p_partkey) FROM part WHERE p_size % 2 = 1)) AND (exempt_ord % 3 <> 0 OR exempt_ord % 2 = 0)")
def settled_records(spark, sf):
    part = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_size")
    records = fact(spark, sf, "exempt_records").withColumn("methods", F.when(F.col("exempt_ord") % 3 == 0, F.array(F.lit("m0"), F.when(F.col("exempt_ord") % 2 == 0, "m1").otherwise("m2"))).otherwise(F.array().cast("array<string>")))
    called = spark.createDataFrame([("m0",), ("m1",)], "id string")
    return exemptions.settled(records, called, part.where("p_size % 2 = 1"), part.where("p_size < 25")).select("exempt_ord", "id", "class")


@query(ctes("exempt_records") + ", o AS (SELECT id, class, CASE class WHEN 'enum-group' THEN 2 WHEN 'generated-file' THEN 3 WHEN 'template-field' THEN 4 ELSE 6 END AS k FROM (SELECT concat('p', exempt_ord % 500) AS id, class FROM exempt_records)) SELECT id, string_agg(class, ',' ORDER BY k) AS classes FROM (SELECT DISTINCT * FROM o) GROUP BY id")
def retaining_classes(spark, sf):
    rows = fact(spark, sf, "exempt_records").select(F.concat(F.lit("p"), F.col("exempt_ord") % 500).alias("id"), "class")
    return exemptions.listed(rows)


@query(ctes("symbols") + " SELECT s.id, 'template-field' AS class, min(d.source) AS detail FROM symbols s JOIN documents d ON s.name = 'Supplier#' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') GROUP BY s.id")
def member_names(spark, sf):
    names = table(spark, sf, "documents").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), F.col("source").alias("site"))
    return exemptions.by_member_names(fact(spark, sf, "symbols").withColumn("visibility", F.lit("public")), names, "template-field")


@query(ctes("symbols") + " SELECT m.id, 'interface-satisfaction' AS class, min(i.id) AS detail FROM symbols m JOIN symbols i ON m.kind = 'function' AND i.kind = 'class' AND m.parent = i.id AND i.exported GROUP BY m.id")
def satisfied_members(spark, sf):
    symbols = fact(spark, sf, "symbols")
    own = symbols.where("kind = 'function'").select("parent", F.lit("call").alias("name"), "id")
    wanted = symbols.where("kind = 'class' and exported").select(F.col("id").alias("parent"), F.lit("call").alias("name"), "id")
    pairs = wanted.select(F.concat(F.lit("i"), "id").alias("interface_id"), F.col("id").alias("class_id"))
    members = own.unionByName(wanted.select(F.concat(F.lit("i"), "id").alias("parent"), "name", "id"))
    return exemptions.of_satisfied_interfaces(pairs, members)


# --- the whole analysis ---------------------------------------------------------------------------------------------


@query()
def analyze_totals(spark, sf):
    facts = {n: fact(spark, sf, n) for n in ("symbols", "roots", "held_seeds", "exempt", "gates")} | {"references": fact(spark, sf, "refs")}
    return rules.totals(analysis.analyze(facts, analysis.Config(least="probable")).findings)


@query(ctes("paths") + " SELECT path, regexp_replace(path, '^[^/]*/', '') AS name, regexp_extract(path, '(\\.[^./]+)$', 1) AS extension, CASE WHEN starts_with(path, 'src/') THEN regexp_replace(path, '^src/', '') ELSE '../' || path END AS from_src FROM paths")
def path_parts(spark, sf):
    rows = fact(spark, sf, "paths").withColumn("src", F.lit("src"))
    return rows.select("path", paths.relative_to("path", "src").alias("from_src"), paths.extension("path").alias("extension"), F.regexp_replace("path", "^[^/]*/", "").alias("name"))


# --- further rules --------------------------------------------------------------------------------------------------


@query("SELECT 'i' || s_nationkey AS interface_id, string_agg(DISTINCT 'k' || (s_suppkey % 7), ',' ORDER BY 'k' || (s_suppkey % 7)) AS classes FROM supplier GROUP BY s_nationkey")
def implementing_classes(spark, sf):
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("i"), "s_nationkey").alias("interface_id"), F.concat(F.lit("k"), F.col("s_suppkey") % 7).alias("class_id"))
    return rules.merge_implementations(rows, rows.select(F.col("interface_id").alias("method_id"), "class_id", F.lit(True).alias("empty")))[0]


@query("SELECT 'm' || (l_partkey % 400) AS method_id, 'k' || l_suppkey AS class_id, bool_and(l_returnflag <> 'R') AS empty FROM lineitem GROUP BY ALL")
def empty_bodies(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("m"), F.col("l_partkey") % 400).alias("method_id"), F.concat(F.lit("k"), "l_suppkey").alias("class_id"), (F.col("l_returnflag") != "R").alias("empty"))
    return rules.merge_implementations(rows.select(F.col("method_id").alias("interface_id"), "class_id"), rows)[1]


@query(ctes("findings") + " SELECT 'o' || l_orderkey AS id, CASE min(CASE confidence WHEN 'possible' THEN 1 WHEN 'probable' THEN 2 ELSE 3 END) WHEN 1 THEN 'possible' WHEN 2 THEN 'probable' ELSE 'certain' END AS ceiling FROM lineitem JOIN findings ON declaration = 'p' || l_partkey GROUP BY l_orderkey")
def test_ceilings(spark, sf):
    targets = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return rules.test_ceilings(targets, fact(spark, sf, "findings").select(F.col("declaration").alias("target"), "confidence"))


@query("SELECT 'y' || year(o_orderdate) AS configuration, count(*) AS questions, count(DISTINCT o_custkey) AS declarations FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL")
def unanswered_counts(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("y"), F.year("o_orderdate")).alias("configuration"), F.col("o_custkey").alias("id"))
    return rules.unanswered_counts(rows)


BRANDS = "WITH m AS (SELECT p_partkey AS id, p_brand AS owner, p_size % 3 AS refs FROM part), n AS (SELECT p_partkey AS id, (p_partkey + 1) % 50 AS namer FROM part)"


@query(BRANDS + " SELECT m.id FROM m JOIN n USING (id) LEFT JOIN m o ON o.id = n.namer GROUP BY m.id HAVING bool_and(coalesce(o.owner = m.owner AND o.refs = 0, false))")
def brand_members(spark, sf):
    part = table(spark, sf, "part")
    members = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), (F.col("p_size") % 3).alias("refs"))
    return rules.brand_members(members, part.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") + 1) % 50).alias("namer")))


@query(LEDGER + " SELECT count(*) AS in_effect, count(DISTINCT site) AS sites FROM ledger JOIN suppressions USING (record_ord) WHERE verdict = 'in-effect'")
def ledger_counts(spark, sf):
    return rules.ledger_counts(_ledger(spark, sf), fact(spark, sf, "suppressions"))


@query("SELECT 'p' || l_partkey AS id, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS chains FROM lineitem GROUP BY l_partkey HAVING bool_and(l_linenumber <> 7)")
def carried_chains(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("to_id"), F.when(F.col("l_linenumber") != 7, F.array(F.concat(F.lit("s"), "l_suppkey"))).otherwise(F.array().cast("array<string>")).alias("carriers"))
    return rules.carried(rows)


@query("SELECT p_brand, quantile_disc(p_size, 0.5) AS median FROM part GROUP BY p_brand")
def lower_median(spark, sf):
    return rules.lower_median(table(spark, sf, "part"), ["p_brand"], "p_size")


@query(ctes("refs", "roots", recursive=True) + ", k(node) AS (SELECT id FROM roots UNION SELECT to_id FROM k JOIN refs ON from_id = node WHERE use <> 'write' AND NOT test AND from_id NOT LIKE 'c%') SELECT node FROM k")
def carrier_reach_of_roots(spark, sf):
    return carrier_reach(fact(spark, sf, "refs"), fact(spark, sf, "roots"), fact(spark, sf, "symbols").where("id like 'c%'"))


@query(FOUND + " SELECT DISTINCT 'ts' AS scheme, code, ref, path FROM found WHERE NOT withheld")
def baseline_document(spark, sf):
    return analysis.baseline_document(_found(spark, sf))


@query(FOUND + " SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM found WHERE NOT withheld AND severity = 'deny'")
def exit_verdict(spark, sf):
    rows = _found(spark, sf)
    return spark.createDataFrame([(rules.verdict(rows, rows.limit(0)),)], "exit_code int")


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS digest FROM documents")
def text_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, octet_length(encode(text)) >= 10240 AND length(text) / len(string_split(text, chr(10))) > 500 AS minified FROM documents")
def minified_files(spark, sf):
    rows = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".js")))
    return rows.select("doc_id", tree.minified().alias("minified"))


DIRECTIVES = "WITH d AS (SELECT 'lib/' || p_brand || '.ts' AS path, CAST(p_partkey AS INT) AS line, CASE p_size % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no-reason' WHEN 2 THEN 'malformed' END AS state FROM part)"


@query(DIRECTIVES + " SELECT * FROM d WHERE state IS NOT NULL")
def inline_directives(spark, sf):
    said = F.element_at(F.array(F.lit("// quietus-ignore DS1001, DS1002: kept"), F.lit("/* quietus-ignore DS1003 */"), F.lit("// quietus-ignore all of it"), F.lit("// nothing of the kind")), (F.col("p_size") % 4 + 1).cast("int"))
    lines = table(spark, sf, "part").select(F.concat(F.lit("lib/"), "p_brand", F.lit(".ts")).alias("path"), F.col("p_partkey").cast("int").alias("line"), said.alias("text"))
    return manifests.inline_directives(lines).select("path", "line", "state")


@query()
def component_roots(spark, sf):
    return rules.component_listing(cut(liveness.components(_judged(spark, sf), fact(spark, sf, "refs"))), cascade=False)
