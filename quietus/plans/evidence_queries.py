"""Evidence, references and listings as queries, beside SQL written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietus.facts.adapters import ctes, fact
from quietus.functions import refs
from quietus.graph.edges import graph_edges
from quietus.operators import evidence, exemptions, liveness, rules, selfcheck, surface
from quietus.plans.queries import EDGES, JUDGED, _judged, query, table
from quietus.session import cut

# --- who made a reference -------------------------------------------------------------------------------------------

_MADE = ctes("symbols", "refs", "support_files") + ", b AS (SELECT *, test OR (consumer = '' AND path IN (SELECT path FROM support_files)) AS by_test FROM refs)"


@query(_MADE + " SELECT use, consumer, by_test, count(*) AS n, count(*) FILTER (WHERE NOT (by_test AND NOT (consumer <> '' AND true))) AS counted FROM b GROUP BY ALL")
def test_edge_classes(spark, sf):
    rows = evidence.made_by_tests(fact(spark, sf, "refs"), fact(spark, sf, "support_files"))
    return rows.groupBy("use", "consumer", "by_test").agg(F.count("*").alias("n"), F.count_if(~evidence.withheld_by(True, True)).alias("counted"))


@query(_MADE + " SELECT DISTINCT to_id AS id FROM b WHERE by_test AND use <> 'write'")
def read_in_tests(spark, sf):
    return evidence.stores(fact(spark, sf, "refs"), fact(spark, sf, "support_files"), True)[1]


@query(_MADE + " SELECT to_id AS id, count(*) FILTER (WHERE use = 'write') AS writes, count(*) FILTER (WHERE use <> 'write') AS reads FROM b WHERE NOT by_test GROUP BY to_id")
def counted_stores(spark, sf):
    rows = evidence.stores(fact(spark, sf, "refs"), fact(spark, sf, "support_files"), True)[0]
    return rows.groupBy(F.col("to_id").alias("id")).agg(F.count_if(F.col("use") == "write").alias("writes"), F.count_if(F.col("use") != "write").alias("reads"))


@query(ctes("symbols", "refs", "held_files") + " SELECT path, count(*) AS n FROM refs WHERE test AND path NOT IN (SELECT path FROM held_files) GROUP BY path")
def outside_test_references(spark, sf):
    return evidence.unheld(fact(spark, sf, "refs"), fact(spark, sf, "held_files")).where("unheld").groupBy("path").agg(F.count("*").alias("n"))


@query(ctes("modules") + ", g AS (SELECT * FROM modules WHERE kind IN ('class', 'enum', 'function') OR block = 'value'), m AS (SELECT c.id AS child, h.parent, h.ref FROM modules c JOIN modules h ON c.parent = h.id WHERE h.kind <> 'file' AND coalesce(h.block, '') <> 'module' AND ((h.block = 'value' AND c.exported) OR (h.kind = 'class' AND c.is_static) OR (h.kind = 'enum' AND c.kind = 'enum-member'))) SELECT h.id, c.id AS child FROM modules c JOIN modules h ON c.parent = h.id WHERE c.exported AND (h.kind = 'file' OR h.block = 'module') UNION SELECT g.id, m.child FROM m JOIN g ON g.parent = m.parent AND g.ref = m.ref WHERE EXISTS (SELECT 1 FROM g v WHERE v.block = 'value' AND v.parent = m.parent AND v.ref = m.ref)")
def whole_reads_of_groups(spark, sf):
    return evidence.whole_reads_of_groups(fact(spark, sf, "modules"))


_EXPOSED = ctes("typed", "typed_carriers", "typed_outside", recursive=True) + ", e AS (SELECT id AS a, carried_id AS b FROM typed_carriers UNION SELECT h.id, c.id FROM typed c JOIN typed h ON c.parent = h.id WHERE c.exported AND ((h.kind IN ('class', 'interface', 'type', 'enum') AND c.kind IN ('method', 'class-member', 'type-member', 'enum-member')) OR h.kind = 'namespace') UNION SELECT c.id, c.parent FROM typed c JOIN typed h ON c.parent = h.id WHERE c.kind IN ('method', 'class-member', 'type-member', 'enum-member')), w(id) AS (SELECT id FROM typed_outside WHERE id IN (SELECT id FROM typed) UNION SELECT e.b FROM w JOIN e ON e.a = w.id WHERE e.b IN (SELECT id FROM typed))"


@query(_EXPOSED + " SELECT id FROM w WHERE id IN (SELECT id FROM typed WHERE kind IN ('class', 'interface', 'type', 'enum'))")
def exposed_over_members(spark, sf):
    typed = fact(spark, sf, "typed")
    return evidence.exposed_types(typed, fact(spark, sf, "typed_carriers"), fact(spark, sf, "typed_outside"), typed.select("id").limit(0))[0]


@query(_EXPOSED + " SELECT id FROM typed WHERE kind IN ('class', 'interface', 'type', 'enum') AND (EXISTS (SELECT 1 FROM w WHERE id IN (SELECT id FROM typed_outside)) OR id IN (SELECT id FROM w))")
def exposed_where_unread(spark, sf):
    return evidence.exposed_types(*[fact(spark, sf, n) for n in ("typed", "typed_carriers", "typed_outside", "typed_outside")])[0]


@query(ctes("symbols", "refs", "counted_in_graph") + ", s AS (SELECT to_id AS id, max(CASE WHEN consumer <> '' THEN 2 WHEN r.path <> y.path THEN 1 ELSE 0 END) AS r, count(*) AS edges FROM refs r JOIN symbols y ON r.to_id = y.id GROUP BY to_id) SELECT id, CASE WHEN coalesce(counted, 0) > coalesce(edges, 0) OR r = 2 THEN 'outside' WHEN r = 1 THEN 'package' ELSE 'file' END AS scope, greatest(coalesce(counted, 0), coalesce(edges, 0)) AS named FROM counted_in_graph FULL JOIN s USING (id) WHERE greatest(coalesce(counted, 0), coalesce(edges, 0)) > 0")
def visibility_with_unseen(spark, sf):
    return evidence.visibility_with_unseen(fact(spark, sf, "refs"), fact(spark, sf, "symbols"), fact(spark, sf, "counted_in_graph"))


# --- seeds, tiers, places -------------------------------------------------------------------------------------------

_RECORDS = "SELECT concat('p', p_partkey) AS id, CASE WHEN p_size % 6 = 1 THEN concat('lib/', p_brand, '.ts') WHEN p_size % 6 = 2 THEN 'none.ts' END AS while_live, p_size % 6 = 3 AS unanswered FROM part WHERE p_size > 40"
_ASKED = "SELECT concat('c', c_custkey) AS id FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal < 0"
_SEEDS = f", xr AS ({_RECORDS}), xa AS ({_ASKED}), seeds AS (SELECT DISTINCT r.id, CASE WHEN while_live IS NOT NULL THEN 'gated' WHEN unanswered THEN 'unanswered' ELSE 'record' END AS tier, f.id AS file FROM xr r LEFT JOIN symbols f ON f.kind = 'file' AND f.path = r.while_live WHERE r.id IN (SELECT id FROM symbols) AND (while_live IS NULL OR f.id IS NOT NULL) UNION SELECT id, 'unanswered', NULL FROM xa WHERE id IN (SELECT id FROM symbols))"


def _seeds(spark, sf):
    view = {n: table(spark, sf, n) for n in ("part", "customer")}
    records = spark.sql(_RECORDS.replace("FROM part", "FROM {part}"), part=view["part"])
    asked = spark.sql(_ASKED.replace("FROM customer", "FROM {customer}"), customer=view["customer"])
    return liveness.seeds_of(records, fact(spark, sf, "symbols"), asked)


@query(ctes("symbols") + _SEEDS + " SELECT id, tier, file FROM seeds")
def seeds_of_records(spark, sf):
    return _seeds(spark, sf)


def _tier_sql() -> str:
    """One walk without levels' names: a node is reached in a tier with that tier's seeds; the gates of a file open once it is reached."""
    level = "CASE WHEN reads = 'export' THEN level WHEN reads = 'gate' THEN 2 WHEN reads = 'passes' THEN CASE WHEN passing THEN 4 WHEN level >= 2 THEN 3 ELSE 1 END WHEN reads = 'whole' THEN 3 ELSE 1 END"
    first = "CASE WHEN reads = 'passes' THEN 4 WHEN reads = 'whole' THEN 3 ELSE 1 END"
    steps = "SELECT from_id AS node, to_id, reads, test, 0 AS since FROM e WHERE inside AND NOT guessed UNION SELECT s.parent, s.id, 'export', false, 0 FROM symbols s JOIN symbols f ON s.parent = f.id AND f.kind = 'file' WHERE s.exported UNION SELECT file, id, 'gate', false, 2 FROM seeds WHERE tier = 'gated'"
    seeds = f"SELECT t.k, r.id AS node, false AS holds, 2 AS level, true AS passing FROM roots r, tiers t WHERE r.id IN (SELECT id FROM symbols) UNION SELECT t.k, id, true, 2, false FROM seeds, tiers t WHERE (tier = 'record' AND t.k >= 1) OR (tier = 'unanswered' AND t.k >= 3) UNION SELECT t.k, to_id, false, {first}, {first} = 4 FROM e, tiers t WHERE NOT inside AND NOT guessed AND NOT test"
    grow = f"SELECT w.k, s.to_id, holds OR reads = 'gate', {level}, ({level}) = 4 FROM w JOIN steps s USING (node) WHERE w.k >= s.since AND (reads <> 'export' OR level >= 3) AND (holds OR NOT test)"
    return ctes("symbols", "refs", "roots", recursive=True) + EDGES + _SEEDS + f", tiers(k) AS (VALUES (0), (1), (2), (3)), steps AS ({steps}), w(k, node, holds, level, passing) AS ({seeds} UNION {grow}) SELECT node AS id, CASE min(k) WHEN 0 THEN 'live' WHEN 1 THEN 'record' WHEN 2 THEN 'gated' ELSE 'unanswered' END AS tier FROM w WHERE node IN (SELECT id FROM symbols) GROUP BY node"


@query(_tier_sql())
def explanation_tiers(spark, sf):
    return liveness.tiers(*[fact(spark, sf, n) for n in ("symbols", "refs", "roots")], cut(_seeds(spark, sf)))


@query(ctes("symbols", "refs", "roots", recursive=True) + ", w(node, depth) AS (SELECT id, 0 FROM roots UNION SELECT to_id, depth + 1 FROM w JOIN refs ON from_id = node WHERE NOT guessed AND depth < 40), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT b.node AS id, min(a.node) AS \"by\" FROM refs r JOIN d a ON a.node = r.from_id JOIN d b ON b.node = r.to_id AND b.depth = a.depth + 1 WHERE NOT r.guessed GROUP BY b.node")
def explained_steps(spark, sf):
    from quietus.graph.walk import reach

    edges = fact(spark, sf, "refs").where("not guessed")
    return evidence.explained_steps(reach(edges, fact(spark, sf, "roots").select(F.col("id").alias("node"))), edges)


@query(JUDGED + ", u(id) AS (SELECT id FROM symbols WHERE kind = 'interface' UNION SELECT r.to_id FROM u JOIN refs r ON r.from_id = u.id WHERE r.to_id IN (SELECT id FROM judged WHERE dead)) SELECT id FROM u")
def possibly_loaded(spark, sf):
    judged = cut(_judged(spark, sf))
    return liveness.possibly_loaded(fact(spark, sf, "refs"), judged.where("kind = 'interface'").select("id"), judged.where("dead").select("id"))


@query(ctes("findings", "edge_sides", recursive=True) + ", m AS (SELECT edge AS finding, symbol AS id FROM edge_sides), p AS (SELECT declaration AS id, component FROM findings), t AS (SELECT DISTINCT a.component AS a, b.component AS b FROM m x JOIN p a ON a.id = x.id JOIN m y ON y.finding = x.finding JOIN p b ON b.id = y.id), c(a, b) AS (SELECT a, b FROM t UNION SELECT c.a, t.b FROM c JOIN t ON c.b = t.a), j AS (SELECT a AS component, min(b) AS joined FROM c GROUP BY a), f AS (SELECT edge AS finding, min(symbol) AS declaration FROM edge_sides GROUP BY edge), l AS (SELECT x.finding, min(p.component) AS least FROM m x JOIN p ON p.id = x.id GROUP BY x.finding), q AS (SELECT f.finding, coalesce(p.component, l.least) AS component FROM f LEFT JOIN p ON p.id = f.declaration LEFT JOIN l ON l.finding = f.finding) SELECT finding, coalesce(joined, q.component) AS component FROM q LEFT JOIN j ON j.component = q.component")
def placed_findings(spark, sf):
    sides = fact(spark, sf, "edge_sides")
    return liveness.placed(sides.groupBy(F.col("edge").alias("finding")).agg(F.min("symbol").alias("declaration")), fact(spark, sf, "findings").select(F.col("declaration").alias("id"), "component"), sides.select(F.col("edge").alias("finding"), F.col("symbol").alias("id")))


# --- exemptions -----------------------------------------------------------------------------------------------------


@query(ctes("typed", "conversions") + " SELECT t.id, 'enum-group' AS class, min(site) AS detail FROM typed t JOIN conversions c ON c.enum_id = t.parent WHERE t.kind = 'enum-member' GROUP BY t.id")
def exempt_enum_groups(spark, sf):
    return exemptions.of_enum_groups(fact(spark, sf, "conversions"), fact(spark, sf, "typed"))


@query(ctes("typed", "decorator_sites") + ", m AS (SELECT id, decorator FROM decorator_sites UNION ALL SELECT t.id, d.decorator FROM typed t JOIN decorator_sites d ON d.id = t.parent WHERE t.kind IN ('method', 'class-member', 'type-member', 'enum-member')) SELECT id, 'decorator' AS class, min(decorator) AS detail FROM m GROUP BY id")
def exempt_decorated(spark, sf):
    return evidence.of_decorators(fact(spark, sf, "decorator_sites"), fact(spark, sf, "typed"))


@query(ctes("typed", "serialized") + " SELECT t.id, 'serialization-contract' AS class, min(site) AS detail FROM typed t JOIN serialized s ON s.type_id = t.parent WHERE t.exported AND t.kind IN ('method', 'class-member', 'type-member', 'enum-member') GROUP BY t.id")
def exempt_serialized(spark, sf):
    return evidence.of_serializers(fact(spark, sf, "serialized"), fact(spark, sf, "typed"))


_DETECTED = ctes("typed", "class_records", "support_files") + ", k AS (SELECT id, class, bool_and(site_path IN (SELECT path FROM support_files)) AS by_test, min(detail) AS detail FROM class_records WHERE id IN (SELECT id FROM typed) GROUP BY id, class)"


def _detected(spark, sf):
    rows = fact(spark, sf, "class_records")
    return evidence.detected([rows.where(F.col("class") == c) for c in ("enum-group", "decorator", "template-field")], fact(spark, sf, "support_files"), fact(spark, sf, "typed"), [c for c, _, _ in exemptions.CLASSES])


@query(_DETECTED + " SELECT id, class, CASE class WHEN 'enum-group' THEN 2 WHEN 'template-field' THEN 4 ELSE 6 END AS class_ord, detail FROM k WHERE NOT by_test")
def exemptions_detected(spark, sf):
    return _detected(spark, sf)[0]


@query(_DETECTED + " SELECT DISTINCT id AS to_id, true AS test FROM k WHERE by_test")
def test_evidence_as_references(spark, sf):
    return _detected(spark, sf)[1]


# --- configured entries, records, bindings --------------------------------------------------------------------------


@query(ctes("typed", "configured_entries") + " SELECT entry, count(DISTINCT t.id) AS ids, count(DISTINCT t.id) > 0 AS matched FROM configured_entries e LEFT JOIN typed t ON (e.ref IS NOT NULL AND t.ref = e.ref) OR (e.ref IS NULL AND t.path = e.module AND t.name = e.name) GROUP BY entry")
def configured_declarations(spark, sf):
    return evidence.configured(fact(spark, sf, "configured_entries"), fact(spark, sf, "typed"))


@query(ctes("typed", "configured_entries") + " SELECT entry AS source FROM configured_entries EXCEPT SELECT entry FROM configured_entries e JOIN typed t ON t.ref = e.ref OR (e.ref IS NULL AND t.path = e.module AND t.name = e.name)")
def unmatched_configured_declarations(spark, sf):
    found = evidence.configured(fact(spark, sf, "configured_entries"), fact(spark, sf, "typed"))
    return selfcheck.unmatched_everywhere(found.select(F.col("entry").alias("source")), found.select(F.col("entry").alias("source"), F.col("ids").alias("found")))


@query(ctes("typed", "record_entries") + ", d AS (SELECT entry, t.id AS bound FROM record_entries e JOIN typed t ON t.ref = e.ref AND t.path = e.path) SELECT entry, bound, false AS by_holder FROM d UNION ALL SELECT e.entry, t.id, true FROM record_entries e JOIN typed t ON t.path = e.path AND t.ref = CASE WHEN ends_with(e.ref, ')') THEN regexp_replace(e.ref, '\\([^(]*$', '') ELSE e.ref END WHERE e.code IN ('DS1401', 'DS1403', 'DS1404', 'DS1405', 'DS1406') AND e.entry NOT IN (SELECT entry FROM d)")
def bound_suppressions(spark, sf):
    return evidence.bound_symbols(fact(spark, sf, "record_entries"), fact(spark, sf, "typed"), refs.parameter_holder("ref"))


@query(ctes("binding_rows") + " SELECT binding, count(DISTINCT configuration) AS configurations FROM binding_rows GROUP BY binding")
def distinct_bindings(spark, sf):
    return evidence.distinct_bindings(fact(spark, sf, "binding_rows"))


@query(ctes("file_needs") + " SELECT \"at\", name, min(path) AS path FROM file_needs GROUP BY \"at\", name HAVING count(DISTINCT path) = 1")
def file_last_uses(spark, sf):
    return evidence.file_last_uses(fact(spark, sf, "file_needs"))


@query(ctes("tree_files", "binding_rows") + " SELECT 'generated' AS part, '{\"path\":\"' || path || '\"}' AS json FROM tree_files UNION ALL SELECT 'binding', '{\"binding\":\"' || replace(binding, '\"', '\\\"') || '\",\"carrier\":\"' || configuration || '\",\"state\":\"read\"}' FROM (SELECT binding, min(configuration) AS configuration FROM binding_rows GROUP BY binding)")
def facts_document(spark, sf):
    bindings = fact(spark, sf, "binding_rows").groupBy("binding").agg(F.min("configuration").alias("carrier"), F.lit("read").alias("state"))
    return evidence.facts_document(fact(spark, sf, "tree_files"), bindings)


# --- orders, caps, messages, references -----------------------------------------------------------------------------


@query(ctes("symbols", "roots") + " SELECT id, root_kind AS kind, row_number() OVER (PARTITION BY path ORDER BY line, id, root_kind) AS ordinal FROM (SELECT s.*, r.kind AS root_kind FROM roots r JOIN symbols s USING (id))")
def ordered_roots(spark, sf):
    from pyspark.sql import Window

    rows = fact(spark, sf, "roots").withColumnRenamed("kind", "root_kind").join(fact(spark, sf, "symbols"), "id")
    return rows.select("id", F.col("root_kind").alias("kind"), F.row_number().over(Window.partitionBy("path").orderBy("line", "id", "root_kind")).alias("ordinal"))


@query(ctes("findings") + ", t AS (SELECT *, row_number() OVER (ORDER BY path, line, col, code, ref) AS k FROM findings) SELECT count(*) FILTER (WHERE k > 100) AS omitted, count(DISTINCT component) FILTER (WHERE k <= 100) AS components FROM t")
def capped_findings(spark, sf):
    rows = fact(spark, sf, "findings").withColumn("lines", F.lit(0))
    _, omitted, components = rules.capped(rows, 100, "position")
    return components.agg(F.lit(omitted).cast("long").alias("omitted"), F.count("*").alias("components"))


_SUBJECT = "CASE kind WHEN 'class-member' THEN 'class member' WHEN 'export-alias' THEN 're-export' WHEN 'type' THEN 'type alias' ELSE kind END || ' ' || name"
_VISIBLE = "CASE WHEN visibility LIKE 'private%' THEN 'private ' WHEN visibility = 'protected' THEN 'protected ' ELSE '' END"


@query(
    ctes("message_rows") + f", s AS (SELECT *, {_SUBJECT} AS s, {_VISIBLE} AS v, relation = 'reachability' AS dead_only, test > 0 AND test = evidence AS ev FROM message_rows), q AS (SELECT *, CASE WHEN code = 'DS1003' THEN v || s WHEN kind = 'export-alias' THEN s WHEN exported THEN 'exported ' || s ELSE 'unexported ' || s END AS q FROM s) SELECT id, CASE "
    "WHEN code IN ('DS1001', 'DS1002', 'DS1003') THEN q || CASE WHEN dead_only THEN ' is referenced only from declarations that are themselves dead' WHEN code = 'DS1001' THEN ' has no reference in the target and none from any loaded consumer' ELSE ' has no reference in the target' END "
    "WHEN code = 'DS1004' THEN 'import binding ' || name || ' is never read in its file' WHEN code = 'DS1005' THEN 'enum member ' || name || ' is named nowhere' WHEN code = 'DS1006' THEN 'type parameter ' || name || ' is named in neither its signature nor its body' "
    "WHEN code = 'DS1101' THEN 'exported ' || s || CASE WHEN dead_only THEN ' is referenced only from declarations that are themselves dead' ELSE ' has no reference in the target' END || ', and nothing outside can import the file that declares it' "
    "WHEN code = 'DS1102' THEN s || CASE WHEN production > 0 AND ev THEN ' is referenced only from declarations that are themselves dead and kept only by evidence in test files' WHEN production > 0 THEN ' is referenced only from test files and from declarations that are themselves dead' WHEN ev THEN ' is referenced from no file and kept only by evidence in test files' ELSE ' is referenced only from test files and never from production code' END "
    "WHEN code = 'DS1103' THEN s || ' references only target symbols that are reported dead' WHEN code = 'DS1104' THEN 'deprecated ' || s || ' has no production reference' "
    "WHEN code = 'DS1201' THEN CASE WHEN dead_only THEN s || ' is named as a type only from declarations that are themselves dead' WHEN test > 0 AND production = 0 THEN s || ' is named as a type only from test files' ELSE 'nothing in the target names ' || s || ' as a type' END "
    "WHEN code = 'DS1202' THEN 'no call site invokes or selects ' || s || ' through the interface' WHEN code = 'DS1301' THEN v || s || ' is written ' || CASE WHEN writes = 1 THEN 'once' ELSE 'at ' || writes || ' positions' END || ' and never read' "
    "WHEN code = 'DS1401' THEN 'parameter ' || name || ' of ' || holder || ' is never read in the body' WHEN code = 'DS1403' THEN 'result ' || name || ' of ' || holder || ' is discarded at every call site' WHEN code = 'DS1404' THEN 'value written to ' || name || ' in ' || holder || ' is never read' WHEN code = 'DS1405' THEN 'statement of ' || holder || ' is unreachable' "
    "WHEN code = 'DS1406' THEN 'case ' || name || ' in ' || holder || ' is covered by an earlier case of the same switch' WHEN code = 'DS1501' THEN 'exported ' || s || ' is referenced only inside the package that declares it' WHEN code = 'DS1503' THEN 'exported ' || s || ' is referenced only inside the file that declares it' "
    "WHEN dead_only THEN 'only code that is itself dead imports file ' || name || ', and no root names it or a declaration in it' ELSE 'no import reaches file ' || name || ' and no root names it or a declaration in it' END AS message FROM q"
)
def messages(spark, sf):
    return fact(spark, sf, "message_rows").select("id", refs.message("code", "kind", "name", "exported", "visibility", "relation", "production", "test", "evidence", "writes", "holder").alias("message"))


_NAMES = "SELECT event_id, event_type AS name, concat(event_type, '''', event_id % 7, chr(92)) AS odd, concat('ts://pkg/src/', event_type, '.ts#') AS module, concat('ts://pkg/src/', event_type, '.ts#f', event_id % 9) AS holder FROM events"


@query(
    f"WITH n AS ({_NAMES}) SELECT event_id, module || name || ':import' AS import_ref, holder || '(' || name || ')' AS parameter_ref, '''' || replace(replace(odd, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') || ''':alias' AS alias, 'pkg/src/' || name || '.ts' = 'pkg/' || regexp_extract(holder, '^ts://[^/]+/([^#]+)', 1) AS same_path, 'f' || (event_id % 9) AS fragment, true AS shaped FROM n"
)
def reference_spelling(spark, sf):
    rows = spark.sql(_NAMES.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))
    block = rows.withColumn("block", F.lit(None).cast("string")).withColumn("parameter", refs.parameter_ref("holder", "name"))
    return block.select(
        "event_id", refs.import_ref("module", "name").alias("import_ref"), "parameter", refs.alias_fragment("odd", "block").alias("alias"),
        (F.concat(F.lit("src/"), "name", F.lit(".ts")) == refs.path_of("holder")).alias("same_path"), refs.fragment_of("holder").alias("fragment"), (refs.is_ref("holder") & (refs.parameter_holder("parameter") == F.col("holder"))).alias("shaped"),
    ).withColumnRenamed("parameter", "parameter_ref")


@query("WITH n AS (SELECT event_id, ['props', event_type || '/~', CAST(event_id % 5 AS VARCHAR)] AS s FROM events) SELECT event_id, '/props/' || replace(replace(s[2], '~', '~0'), '/', '~1') || '/' || s[3] AS pointer, 'props.' || s[2] || '[' || s[3] || ']' AS dotted, true AS same FROM n")
def json_pointers(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.array(F.lit("props"), F.concat("event_type", F.lit("/~")), (F.col("event_id") % 5).cast("string")).alias("s"))
    rows = rows.withColumn("pointer", refs.pointer_of("s"))
    return rows.select("event_id", "pointer", refs.dotted("s").alias("dotted"), (refs.pointer_segments("pointer") == F.col("s")).alias("same"))


@query(ctes("symbols", "refs") + EDGES + " SELECT reads, inside, count(*) AS n FROM e GROUP BY ALL")
def graph_edges_by_mode(spark, sf):
    return graph_edges(fact(spark, sf, "refs"), fact(spark, sf, "symbols")).groupBy("reads", "inside").agg(F.count("*").alias("n"))


_MAY = "(VALUES " + ", ".join(f"('{s}', '{m}')" for s, ms in selfcheck.REMEDIES.items() for m in ms) + ") v(subject, mechanism)"


@query(ctes("spoken_findings") + f", f AS (SELECT code, CASE WHEN code = 'DS1401' THEN 'part' WHEN code = 'DS1602' THEN 'file' WHEN code LIKE 'DS9%' THEN 'record' ELSE 'declaration' END AS subject FROM spoken_findings) SELECT code, mechanism, count(*) AS findings FROM f JOIN {_MAY} USING (subject) GROUP BY ALL")
def remedies(spark, sf):
    rows = fact(spark, sf, "spoken_findings").select("code", selfcheck.subject_of("code").alias("subject"))
    return rows.join(F.broadcast(selfcheck.remedies(spark)), "subject").groupBy("code", "mechanism").agg(F.count("*").alias("findings"))


# --- what a consumer can name ---------------------------------------------------------------------------------------

_SURFACE = """, s AS (SELECT * FROM surface_symbols), u AS (SELECT * FROM surface_uses WHERE from_id NOT IN (SELECT id FROM s WHERE kind = 'file')),
e AS (SELECT h.id AS a, m.id AS b FROM s m JOIN s h ON m.parent = h.id WHERE m.kind <> 'type-parameter' AND (h.global_block OR NOT m.type_only AND CASE WHEN h.kind IN ('file', 'namespace') THEN m.exported ELSE m.visibility NOT IN ('private', 'private-name') END)
  UNION SELECT from_id, to_id FROM u WHERE to_id IS NOT NULL UNION SELECT u.from_id, s.id FROM u JOIN s ON u.name = s.name WHERE u.to_id IS NULL
  UNION SELECT i.from_id, i.to_id FROM surface_inferred i JOIN s ON i.to_id = s.id WHERE NOT i.member OR s.visibility IN ('public', 'protected')
  UNION SELECT d.id, b.id FROM s d JOIN s b ON d.path = b.path WHERE b.global_block AND d.kind <> 'file'),
w(id) AS (SELECT id FROM {seeds} WHERE id IN (SELECT id FROM s) UNION SELECT e.b FROM w JOIN e ON w.id = e.a)
SELECT id, EXISTS (SELECT 1 FROM w g JOIN u ON u.from_id = g.id JOIN s z ON z.name = u.name WHERE u.to_id IS NULL AND z.id = w.id) AS guessed FROM w WHERE id IN (SELECT id FROM s WHERE kind <> 'file')"""
_SURFACE_FACTS = ("surface_symbols", "surface_uses", "surface_inferred", "surface_published", "surface_exports", "surface_statements")
_TAGGED = "SELECT DISTINCT t.id FROM surface_statements t JOIN surface_symbols s ON s.id = t.id WHERE s.exported AND t.leading LIKE '%@beta */'"


@query(ctes("surface_symbols", "surface_statements") + " " + _TAGGED)
def release_tags(spark, sf):
    rows = fact(spark, sf, "surface_statements").where(surface.release_tagged(F.col("leading"))).select("id").distinct()
    return rows.join(fact(spark, sf, "surface_symbols").where("exported").select("id"), "id", "left_semi")


@query(
    ctes(*_SURFACE_FACTS, recursive=True)
    + _SURFACE.replace("{seeds}", f"({_TAGGED} UNION SELECT id FROM surface_exports WHERE file IN (SELECT id FROM surface_published) UNION SELECT b.id FROM surface_symbols b WHERE b.global_block AND b.path IN (SELECT path FROM surface_symbols WHERE id IN (SELECT id FROM surface_published)))")
)
def published_api(spark, sf):
    symbols, uses, inferred, files, exports, statements = [fact(spark, sf, n) for n in _SURFACE_FACTS]
    tagged = statements.where(surface.release_tagged(F.col("leading"))).select("id")
    return surface.published_api(symbols, uses, files, exports, tagged, inferred)


@query(ctes(*_SURFACE_FACTS, recursive=True) + _SURFACE.replace("{seeds}", "(SELECT id FROM surface_exports WHERE id LIKE '%7')"))
def reached_types(spark, sf):
    symbols, uses, inferred = [fact(spark, sf, n) for n in _SURFACE_FACTS[:3]]
    return surface.reached_types(symbols, uses, fact(spark, sf, "surface_exports").where("id like '%7'"), inferred)
