"""Star-schema tables as code facts: the deterministic mapping through which the operators are exercised.

Each fact is one portable SELECT. Spark runs it over DataFrames; the SQL oracles start from the same SELECTs as common table expressions, so both sides judge the
same facts and only the operators differ. A condition in a fact is part of the mapping (it says which rows stand for a reference, a root or a record);
queries read every row of the facts they take.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations"]

FACTS: dict[str, str] = {
    "symbols": """
        SELECT concat('n', n_nationkey) AS id, 'file' AS kind, concat('src/n', n_nationkey, '.ts') AS path, 1 AS line, 400 AS end_line, '' AS parent, false AS exported, n_name AS name FROM nation
        UNION ALL SELECT DISTINCT concat('b', p_brand), 'file', concat('lib/', p_brand, '.ts'), 1, 400, '', false, p_brand FROM part
        UNION ALL SELECT concat('c', c_custkey), 'class', concat('src/n', c_nationkey, '.ts'), CAST(c_custkey % 300 + 2 AS INT), CAST(c_custkey % 300 + 2 + c_custkey % 7 AS INT), concat('n', c_nationkey), c_acctbal > 5000, c_name FROM customer
        UNION ALL SELECT concat('s', s_suppkey), 'interface', concat('src/n', s_nationkey, '.ts'), CAST(s_suppkey % 90 + 310 AS INT), CAST(s_suppkey % 90 + 312 AS INT), concat('n', s_nationkey), s_acctbal > 0, s_name FROM supplier
        UNION ALL SELECT concat('p', p_partkey), 'variable', concat('lib/', p_brand, '.ts'), CAST(p_partkey % 200 + 2 AS INT), CAST(p_partkey % 200 + 2 + p_size % 5 AS INT), concat('b', p_brand), p_size % 2 = 0, p_name FROM part
        UNION ALL SELECT concat('o', o_orderkey), 'function', concat('app/m', o_custkey % 40, '.ts'), CAST(o_orderkey % 500 + 1 AS INT), CAST(o_orderkey % 500 + 1 + o_orderkey % 9 AS INT), concat('c', o_custkey), o_orderpriority = '2-HIGH', concat('order', o_orderkey) FROM orders""",
    "refs": """
        SELECT concat('o', o_orderkey) AS from_id, concat('c', o_custkey) AS to_id, 'read' AS use, o_orderpriority = '1-URGENT' AS test, false AS guessed, false AS namespace, false AS reexport, '' AS consumer, concat('app/m', o_custkey % 40, '.ts') AS path, CAST(o_orderkey % 500 + 1 AS INT) AS line FROM orders
        UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END, l_linenumber = 7, l_linestatus = 'O' AND l_linenumber = 6, false, false, '', concat('app/l', l_orderkey % 40, '.ts'), CAST(l_linenumber AS INT) FROM lineitem
        UNION ALL SELECT concat('o', l_orderkey), concat('s', l_suppkey), 'read', l_linenumber = 5, false, false, false, '', concat('app/l', l_orderkey % 40, '.ts'), CAST(l_linenumber + 50 AS INT) FROM lineitem
        UNION ALL SELECT concat('p', p_partkey), concat('p', (CAST(floor(p_partkey / 3) AS BIGINT) + p_size) % (SELECT count(*) FROM part)), 'read', false, false, p_size % 2 = 0, p_size % 4 = 0, '', concat('lib/', p_brand, '.ts'), CAST(p_partkey % 200 + 2 AS INT) FROM part
        UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'read', false, false, c_custkey % 10 = 0, c_custkey % 20 = 0, '', concat('src/n', c_nationkey, '.ts'), CAST(c_custkey % 300 + 2 AS INT) FROM customer
        UNION ALL SELECT concat('c', o_custkey), concat('o', min(o_orderkey)), 'read', false, false, false, false, '', concat('src/x', o_custkey % 9, '.ts'), 1 FROM orders GROUP BY o_custkey
        UNION ALL SELECT 'outside', concat('c', c_custkey), 'read', false, false, c_custkey % 2 = 0, c_custkey % 2 = 0, 'shop', 'index.ts', 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000""",
    "roots": """
        SELECT concat('o', o_orderkey) AS id, 'configured' AS kind FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000
        UNION ALL SELECT concat('c', c_custkey), 'published-api' FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9500""",
    "held_seeds": "SELECT concat('p', p_partkey) AS id FROM part WHERE p_size = 49",
    "gates": "SELECT concat('n', c_nationkey) AS file, concat('c', c_custkey) AS id FROM customer WHERE c_custkey % 97 = 0",
    "exempt": "SELECT concat('p', p_partkey) AS id FROM part WHERE p_size = 7",
    "cfg_symbols": """
        SELECT DISTINCT concat('y', year(o_orderdate)) AS configuration, CAST(year(o_orderdate) AS INT) AS config_ord, concat('c', o_custkey) AS id, o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0 AS reference_only, concat('class', year(o_orderdate) % 2) AS kind FROM orders
        UNION ALL SELECT DISTINCT concat('y', year(l_shipdate)), CAST(year(l_shipdate) AS INT), concat('p', l_partkey), l_partkey % 11 = 0, 'variable' FROM lineitem""",
    "cfg_refs": """
        SELECT concat('y', year(l_shipdate)) AS configuration, CAST(year(l_shipdate) AS INT) AS config_ord, l_orderkey * 10 + l_linenumber AS ref_ord, '' AS consumer, concat('g', l_suppkey % 10) AS from_id, concat('p', l_partkey) AS to_id, concat('g', l_suppkey % 10, '.ts') AS path, CAST(l_linenumber % 2 AS INT) AS line, 1 AS col, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS use FROM lineitem""",
    "manifest_docs": """
        SELECT concat('src/n', n_nationkey, '/package.json') AS path, concat('{"name":"n', n_nationkey, '","main":"./lib/main.ts","bin":{"n":"./bin/run', n_nationkey, '.js"},"scripts":{"build":"tsc -p src/n', n_nationkey, '.ts && node ./lib/main.ts","test":"vitest run"},"dependencies":{"pkg', n_nationkey % 5, '":"^1.', n_nationkey, '.0","tsc":"*"},"devDependencies":{"vitest":"~2.0.', n_nationkey, '"}}') AS text FROM nation""",
    "paths": "SELECT DISTINCT path FROM symbols",
    "exempt_records": """
        SELECT CAST(p_partkey AS BIGINT) AS exempt_ord, concat('p', p_partkey) AS id, CASE p_size % 4 WHEN 0 THEN 'enum-group' WHEN 1 THEN 'decorator' WHEN 2 THEN 'template-field' ELSE 'generated-file' END AS class, CASE WHEN p_size % 3 = 0 THEN concat('p', (p_partkey * 5 + 1) % 2000) END AS while_live, p_size % 6 = 5 AS while_written, CASE WHEN p_partkey % 5 = 0 THEN 'private' ELSE 'public' END AS visibility FROM part""",
    "store_refs": "SELECT concat('v', l_orderkey) AS to_id, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS use, concat('app/l', l_orderkey % 40, '.ts') AS path, CAST(l_linenumber AS INT) AS line FROM lineitem",
    "findings": """
        SELECT concat('DS', 1001 + p_size % 4) AS code, concat('p', p_partkey) AS declaration, concat('ts://lib/', p_name) AS ref, concat('lib/', p_brand, '.ts') AS path, CAST(p_partkey % 200 + 2 AS INT) AS line, 1 AS col, CASE WHEN p_size % 5 = 0 THEN 'possible' WHEN p_size % 5 = 1 THEN 'probable' ELSE 'certain' END AS confidence, concat('k', p_partkey % 300) AS component, p_partkey % 4 = 0 AS is_root, p_size AS subject_lines FROM part""",
    "suppressions": """
        SELECT CAST(p_partkey AS BIGINT) AS record_ord, concat('DS', 1001 + p_size % 5) AS code, concat('ts://lib/', p_name) AS symbol, concat('lib/', p_brand, '.ts') AS path, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('p', p_partkey) END AS bound, 'ignore' AS mechanism, concat('site', p_partkey % 50) AS site FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT CAST(p_partkey + 1000000 AS BIGINT), concat('DS', 1001 + p_size % 4), concat('ts://lib/', p_name), concat('lib/', p_brand, '.ts'), concat('p', p_partkey), 'baseline', concat('site', p_partkey % 50) FROM part WHERE p_size % 7 = 0
        UNION ALL SELECT CAST(p_partkey + 2000000 AS BIGINT), concat('DS', 1001 + p_size % 4), '', concat('lib/', p_brand, '.ts'), CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('p', p_partkey) END, 'inline', concat('line', p_partkey) FROM part WHERE p_size % 11 = 0""",
    "manifests": """
        SELECT '' AS dir, concat('pkg', n_nationkey % 5) AS name FROM nation
        UNION ALL SELECT 'src', concat('pkg', n_nationkey % 7) FROM nation
        UNION ALL SELECT concat('src/r', n_regionkey), concat('pkg', n_nationkey) FROM nation
        UNION ALL SELECT concat('src/r', n_regionkey, '/n', n_nationkey), concat('pkg', n_nationkey % 9) FROM nation""",
    "dep_files": "SELECT concat('src/r', n_regionkey, '/n', n_nationkey, '/c', c_custkey % 10) AS dir, concat('pkg', c_custkey % 30) AS name, concat('c', c_custkey) AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "intervals": "SELECT path, line AS from_line, end_line AS to_line, id FROM symbols WHERE kind IN ('class', 'interface')",
    "points": "SELECT concat('src/n', c_nationkey, '.ts') AS path, CAST(c_custkey * 13 % 420 AS INT) AS line, concat('q', c_custkey) AS point FROM customer",
    "patterns": "SELECT 0 AS pattern_ord, 'src/**/*.ts' AS pattern UNION ALL SELECT 1, 'lib/{Brand#11,Brand#2?}.ts' UNION ALL SELECT 2, 'app/m[0-9].ts' UNION ALL SELECT 3, '**/l?*.ts' UNION ALL SELECT 4, 'src/n1*.ts'",
    "file_uses": "SELECT DISTINCT r.path AS from_path, s.path AS to_path FROM refs r JOIN symbols s ON r.to_id = s.id WHERE r.path <> s.path AND r.consumer = '' AND (r.from_id NOT LIKE 'p%' OR r.line % 60 = 5) UNION SELECT 'app/m1.ts', concat('lib/', p_brand, '.ts') FROM part WHERE p_partkey % 500 = 3",
    "test_files": "SELECT DISTINCT concat('app/l', o_orderkey % 40, '.ts') AS path FROM orders",
    "root_files": "SELECT concat('src/n', n_nationkey, '.ts') AS path FROM nation WHERE n_nationkey % 12 = 0",
    "carriers": "SELECT concat('c', c_custkey) AS id, concat('c', (CAST(floor(c_custkey / 3) AS BIGINT) + c_custkey % 50) % (SELECT count(*) FROM customer)) AS carried_id FROM customer",
    "peers": "SELECT concat('pkg', n_nationkey) AS name, concat('pkg', (n_nationkey * 3 + 2) % 25) AS peer FROM nation WHERE n_nationkey % 6 <> 5",
    "parts_found": "SELECT concat('y', year(l_shipdate)) AS configuration, concat('o', l_partkey) AS declaration, concat('a', l_suppkey % 3) AS name, l_returnflag = 'R' AS in_use FROM lineitem",
    "parts_judging": "SELECT DISTINCT concat('y', year(l_shipdate)) AS configuration, concat('o', l_partkey) AS declaration FROM lineitem",
    "candidates": """
        SELECT concat('d', o_orderkey) AS id, CASE o_orderkey % 12 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'variable' WHEN 3 THEN 'interface' WHEN 4 THEN 'interface-method' WHEN 5 THEN 'type-parameter' WHEN 6 THEN 'enum-member' WHEN 7 THEN 'method' WHEN 8 THEN 'class-member' WHEN 9 THEN 'type-member' WHEN 10 THEN 'type' ELSE 'file' END AS kind,
        o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS exported, CASE o_custkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'type' WHEN 2 THEN 'enum' WHEN 3 THEN 'method' ELSE 'file' END AS parent_kind, o_custkey % 9 = 0 OR o_orderstatus = 'P' AS container_dead,
        o_custkey % 7 = 0 AS in_test, o_custkey % 29 = 0 AS test_of_dead, o_custkey % 4 = 1 AS unreferenced_test, o_custkey % 31 = 0 AS held_by_itself, o_custkey % 5 = 0 AS kept_by_tests, CAST(CASE WHEN o_totalprice > 200000 THEN 2 ELSE 0 END AS BIGINT) AS production,
        CAST(CASE WHEN o_totalprice < 60000 OR o_totalprice > 300000 THEN 1 ELSE 0 END AS BIGINT) AS test, CASE WHEN o_totalprice > 200000 THEN 'reachability' ELSE 'reference-counting' END AS relation, o_custkey % 11 = 0 AS deprecated, o_custkey % 13 = 0 AS brand, o_custkey % 17 = 0 AS marker, o_custkey % 2 = 0 AS encapsulated, o_custkey % 8 = 0 AS rooted FROM orders""",
    "subjects": """
        SELECT concat('x', n_nationkey) AS id, 'file' AS kind, concat(CASE WHEN n_nationkey % 5 = 0 THEN 'src/__mocks__/f' ELSE 'src/f' END, n_nationkey, '.ts') AS path, 1 AS line, '' AS parent, '' AS parent_kind, false AS exported, false AS written, CAST(0 AS BIGINT) AS named, 'file' AS scope, false AS exposed, concat('file', n_nationkey) AS name FROM nation
        UNION ALL SELECT concat('y', c_custkey), CASE c_custkey % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'variable' WHEN 3 THEN 'interface' ELSE 'export-alias' END, concat(CASE WHEN c_custkey % 5 = 0 THEN 'src/__mocks__/f' ELSE 'src/f' END, c_custkey % 25, '.ts'), CAST(c_custkey % 400 + 2 AS INT), concat('x', c_custkey % 25),
        CASE WHEN c_custkey % 11 = 0 THEN 'class' ELSE 'file' END, c_acctbal > 0, c_custkey % 7 = 3, CAST(c_custkey % 7 AS BIGINT), CASE c_custkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'package' ELSE 'outside' END, c_mktsegment = 'BUILDING', concat('decl', c_custkey % 700) FROM customer""",
    "subject_roots": """
        SELECT concat('y', o_custkey) AS id, CASE WHEN o_custkey % 25 >= 10 AND o_orderkey % 21 IN (1, 5) THEN 'pattern' ELSE CASE o_orderkey % 21 WHEN 0 THEN 'entry-file' WHEN 1 THEN 'manifest-entry' WHEN 2 THEN 'manifest-binary' WHEN 3 THEN 'script' WHEN 4 THEN 'type-query-alias' WHEN 5 THEN 'published-api' WHEN 6 THEN 'entry-reach' WHEN 7 THEN 'test-reach' WHEN 8 THEN 'configured' WHEN 9 THEN 'pattern' WHEN 10 THEN 'type-error' WHEN 11 THEN 'global-augmentation' WHEN 12 THEN 'configuration-file' WHEN 13 THEN 'configuration-string' WHEN 14 THEN 'bundler-entry' WHEN 15 THEN 'test-runner' WHEN 16 THEN 'convention' WHEN 17 THEN 'html-entry' WHEN 18 THEN 'html-import' WHEN 19 THEN 'document-import' ELSE 'workflow-step' END END AS kind FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
        UNION ALL SELECT concat('x', n_nationkey), CASE n_nationkey % 6 WHEN 0 THEN 'test-runner' WHEN 1 THEN 'document-import' WHEN 2 THEN 'manifest-entry' WHEN 3 THEN 'script' WHEN 4 THEN 'entry-reach' ELSE 'convention' END FROM nation""",
    "function_parts": """
        SELECT concat('o', l_orderkey) AS declaration, CASE l_linenumber WHEN 4 THEN 'result' WHEN 5 THEN 'dead-store' WHEN 6 THEN 'unreachable-statement' WHEN 7 THEN 'unreachable-case' ELSE 'parameter' END AS kind, concat('q', l_linenumber) AS name, l_returnflag = 'R' AS in_value, l_linestatus = 'O' AS counted,
        CASE l_suppkey % 4 WHEN 0 THEN 'steers' WHEN 1 THEN 'free' END AS annotated, l_partkey % 3 = 0 AS before_a_read, l_partkey % 5 = 0 AS contextual FROM lineitem""",
    "function_signatures": "SELECT concat('o', o_orderkey) AS declaration, CASE o_custkey % 4 WHEN 1 THEN 'valued' WHEN 2 THEN 'fixed' ELSE 'free' END AS state, o_custkey % 10 = 0 AS rooted, o_custkey % 7 = 0 AS callers_unknown FROM orders",
    "calls": "SELECT concat('y', year(l_shipdate)) AS configuration, concat('o', l_orderkey) AS declaration, CASE WHEN l_quantity > 12 THEN 'discarded' ELSE 'used' END AS use FROM lineitem",
    "skipped": "SELECT concat('app/m', c_custkey % 40, '.ts') AS path, CAST(c_custkey % 480 AS INT) AS from_line, CAST(c_custkey % 480 + c_custkey % 6 AS INT) AS to_line FROM customer",
    "cases": "SELECT l_orderkey AS switch, CAST(l_linenumber AS INT) AS position, CASE WHEN l_returnflag <> 'A' THEN concat('case', l_suppkey % 4) END AS key FROM lineitem",
    "written_records": "SELECT CAST(p_partkey AS BIGINT) AS record_ord, CASE p_size % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'because' END AS reason, CASE WHEN p_size % 6 = 0 THEN '' ELSE concat('lib/', p_brand, '.ts') END AS path FROM part",
    "asked_roots": "SELECT concat('r', c_custkey) AS source FROM customer",
    "matched_roots": "SELECT concat('y', year(o_orderdate)) AS project, concat('r', o_custkey) AS source, CAST(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS BIGINT) AS found FROM orders",
    "root_patterns": "SELECT concat('ts://lib/', p_brand, '.ts#', p_name) AS source FROM part UNION ALL SELECT DISTINCT concat('ts://lib/', substring(p_brand, 1, 7), '?.ts#', substring(p_name, 1, 3), '*') FROM part UNION ALL SELECT 'ts://none#*' FROM region",
    "refs_of_symbols": "SELECT id, concat('ts://', path, '#', name) AS ref, path, line, kind FROM symbols",
    "tree_files": "SELECT DISTINCT concat('app/m', o_custkey % 47, '.ts') AS path FROM orders",
    "projects": "SELECT concat('project', s_suppkey) AS project, CASE s_suppkey % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'empty' WHEN 2 THEN 'duplicate' ELSE 'read' END AS status, s_nationkey % 2 = 0 AS named, s_nationkey % 3 = 0 AS optional FROM supplier",
    "loose_findings": """
        SELECT concat('f', o_orderkey) AS finding, concat('ts://app/m', o_custkey % 40, '.ts#', CASE WHEN o_custkey % 3 = 0 THEN concat('order', o_orderkey) ELSE concat('gone', o_orderkey) END) AS ref, CASE WHEN o_custkey % 5 = 0 THEN concat('ts://app/m', o_custkey % 40, '.ts#order', o_orderkey) END AS holder, concat('app/m', o_custkey % 40, '.ts') AS path,
        CAST(o_orderkey % 500 + 1 + o_custkey % 2 AS INT) AS line, CASE o_orderkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'file' ELSE 'function' END AS kind FROM orders""",
    "spoken_findings": """
        SELECT concat('f', p_partkey) AS finding, CASE p_size % 5 WHEN 0 THEN 'DS1401' WHEN 1 THEN 'DS1602' WHEN 2 THEN 'DS9003' ELSE 'DS1001' END AS code, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat('p', p_partkey % 1500) END AS declaration, concat('ts://', p_name) AS ref, CASE WHEN p_size % 5 = 0 THEN concat('ts://holder', p_partkey % 100) END AS holder, concat('lib/', p_brand, '.ts') AS path FROM part""",
    "spoken_records": """
        SELECT CAST(p_partkey AS BIGINT) AS record_ord, CASE p_size % 5 WHEN 0 THEN 'DS1401' WHEN 1 THEN 'DS1602' WHEN 2 THEN 'DS9003' ELSE 'DS1001' END AS code, CASE p_partkey % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'ignore' ELSE 'baseline' END AS mechanism, CASE WHEN p_size % 5 = 0 AND p_partkey % 2 = 0 THEN concat('ts://holder', p_partkey % 100) ELSE concat('ts://', p_name) END AS symbol, concat('lib/', p_brand, '.ts') AS path,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('p', p_partkey % 1500) END AS bound, CASE WHEN p_partkey % 9 = 0 THEN 'lib/other.ts' ELSE concat('lib/', p_brand, '.ts') END AS site_path, concat('site', p_partkey % 60) AS site FROM part""",
    "modules": """
        SELECT concat('f', n_nationkey) AS id, 'file' AS kind, '' AS parent, concat('ts://f', n_nationkey, '#') AS ref, false AS exported, false AS is_static, CAST(NULL AS STRING) AS block FROM nation
        UNION ALL SELECT concat('h', s_suppkey), CASE s_suppkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'enum' WHEN 2 THEN 'namespace' WHEN 3 THEN 'namespace' WHEN 4 THEN 'function' ELSE 'namespace' END, concat('f', s_nationkey), concat('ts://f', s_nationkey, '#g', s_suppkey % 3), s_acctbal > 0, false, CASE s_suppkey % 6 WHEN 2 THEN 'value' WHEN 3 THEN 'module' ELSE CAST(NULL AS STRING) END FROM supplier
        UNION ALL SELECT concat('m', c_custkey), CASE c_custkey % 4 WHEN 0 THEN 'enum-member' WHEN 1 THEN 'method' WHEN 2 THEN 'class-member' ELSE 'variable' END, concat('h', 1 + c_custkey % (SELECT count(*) FROM supplier)), concat('ts://m', c_custkey), c_acctbal > 1000, c_custkey % 7 < 3, CAST(NULL AS STRING) FROM customer""",
    "support_files": "SELECT DISTINCT concat('app/l', o_orderkey % 40, '.ts') AS path FROM orders WHERE o_orderkey % 40 < 9",
    "held_files": "SELECT DISTINCT concat('app/m', o_custkey % 40, '.ts') AS path FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey % 40 < 30",
    "typed": """
        SELECT concat('t', c_custkey) AS id, CASE c_custkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'namespace' WHEN 3 THEN 'function' ELSE 'enum' END AS kind, 'file' AS parent, c_acctbal > 0 AS exported, concat('type', c_custkey) AS name, concat('src/t', c_nationkey, '.ts') AS path, concat('ts://src/t', c_nationkey, '#type', c_custkey) AS ref FROM customer
        UNION ALL SELECT concat('u', p_partkey), CASE p_partkey % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'type-member' WHEN 2 THEN 'class-member' ELSE 'enum-member' END, concat('t', p_partkey % (SELECT count(*) FROM customer)), p_size % 3 > 0, concat('member', p_partkey % 50), 'src/u.ts', concat('ts://src/u.ts#member', p_partkey) FROM part""",
    "typed_carriers": "SELECT concat('t', c_custkey) AS id, concat('t', (c_custkey * 7 + 3) % (SELECT count(*) FROM customer)) AS carried_id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "typed_outside": "SELECT concat('t', c_custkey) AS id FROM customer WHERE c_acctbal > 9700",
    "counted_in_graph": "SELECT concat('c', c_custkey) AS id, CAST(c_custkey % 25 AS BIGINT) AS counted FROM customer",
    "decorator_sites": "SELECT concat('t', o_custkey) AS id, concat('@', o_orderpriority) AS decorator FROM orders WHERE o_orderstatus = 'P'",
    "conversions": "SELECT concat('t', o_custkey) AS enum_id, concat('app/l', o_orderkey % 40, '.ts') AS site FROM orders WHERE o_orderpriority = '5-LOW'",
    "serialized": "SELECT concat('t', o_custkey) AS type_id, concat('app/l', o_orderkey % 40, '.ts') AS site FROM orders WHERE o_totalprice > 400000",
    "class_records": "SELECT concat('u', l_partkey) AS id, CASE l_linenumber % 3 WHEN 0 THEN 'enum-group' WHEN 1 THEN 'decorator' ELSE 'template-field' END AS class, concat('d', l_suppkey % 9) AS detail, concat('app/l', l_orderkey % 40, '.ts') AS site_path FROM lineitem",
    "configured_entries": "SELECT concat('by-ref', s_suppkey) AS entry, concat('ts://src/t', s_nationkey, '#type', s_suppkey) AS ref, CAST(NULL AS STRING) AS module, CAST(NULL AS STRING) AS name FROM supplier UNION ALL SELECT concat('by-name', s_suppkey), CAST(NULL AS STRING), 'src/u.ts', concat('member', s_suppkey) FROM supplier",
    "record_entries": "SELECT concat('entry', p_partkey) AS entry, CASE p_size % 3 WHEN 0 THEN 'DS1401' WHEN 1 THEN 'DS1406' ELSE 'DS1003' END AS code, CASE WHEN p_size % 2 = 0 THEN concat('ts://src/u.ts#member', p_partkey, '(arg)') ELSE concat('ts://src/u.ts#member', p_partkey * 2) END AS ref, 'src/u.ts' AS path FROM part",
    "binding_rows": "SELECT concat('y', year(o_orderdate)) AS configuration, concat('{\"service\":\"s', o_custkey % 90, '\",\"status\":\"', o_orderstatus, '\"}') AS binding FROM orders",
    "file_needs": "SELECT concat('src/n', o_custkey % 7) AS at, concat('pkg', o_custkey % 300) AS name, concat('app/m', o_orderkey % 40, '.ts') AS path FROM orders",
    "message_rows": """
        SELECT concat('o', o_orderkey) AS id, CASE o_orderkey % 21 WHEN 0 THEN 'DS1001' WHEN 1 THEN 'DS1002' WHEN 2 THEN 'DS1003' WHEN 3 THEN 'DS1004' WHEN 4 THEN 'DS1005' WHEN 5 THEN 'DS1006' WHEN 6 THEN 'DS1101' WHEN 7 THEN 'DS1102' WHEN 8 THEN 'DS1103' WHEN 9 THEN 'DS1104' WHEN 10 THEN 'DS1201' WHEN 11 THEN 'DS1202' WHEN 12 THEN 'DS1301' WHEN 13 THEN 'DS1401' WHEN 14 THEN 'DS1403' WHEN 15 THEN 'DS1404' WHEN 16 THEN 'DS1405' WHEN 17 THEN 'DS1406' WHEN 18 THEN 'DS1501' WHEN 19 THEN 'DS1503' ELSE 'DS1602' END AS code,
        CASE o_custkey % 5 WHEN 0 THEN 'class-member' WHEN 1 THEN 'export-alias' WHEN 2 THEN 'type' ELSE 'function' END AS kind, concat('n', o_custkey) AS name, o_orderpriority IN ('1-URGENT', '2-HIGH') AS exported, CASE o_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN 'private-name' ELSE 'public' END AS visibility,
        CASE WHEN o_orderstatus = 'F' THEN 'reachability' ELSE 'reference-counting' END AS relation, CAST(o_custkey % 3 AS BIGINT) AS production, CAST(o_custkey % 4 AS BIGINT) AS test, CAST(CASE WHEN o_custkey % 7 < 4 THEN o_custkey % 4 ELSE 0 END AS BIGINT) AS evidence, CAST(1 + o_custkey % 3 AS BIGINT) AS writes, concat('h', o_custkey % 50) AS holder FROM orders""",
    "module_refs": """
        SELECT concat('m', o_custkey) AS from_id, concat('h', 1 + o_orderkey % (SELECT count(*) FROM supplier)) AS to_id, CASE WHEN o_orderstatus = 'P' THEN 'write' ELSE 'read' END AS use, o_orderpriority = '1-URGENT' AS test, false AS guessed, o_orderkey % 3 = 0 AS namespace, o_orderkey % 2 = 0 AS reexport, '' AS consumer FROM orders
        UNION ALL SELECT concat('f', n_nationkey), concat('f', (n_nationkey + 7) % 25), 'read', false, false, n_nationkey % 3 = 0, n_nationkey % 2 = 0, '' FROM nation
        UNION ALL SELECT concat('h', s_suppkey), concat('m', s_suppkey * 5), 'read', false, false, false, false, '' FROM supplier""",
    "module_roots": "SELECT concat('f', n_nationkey) AS id FROM nation WHERE n_regionkey = 2",
    "members": """
        SELECT concat('wide', o_orderkey) AS key, concat('o', o_orderkey) AS within, 2 AS from_line, 1 AS from_col, 5 AS to_line, 9 AS to_col FROM orders
        UNION ALL SELECT concat('slim', o_orderkey), concat('o', o_orderkey), 3, 2, 3, 9 FROM orders""",
    "placed_refs": "SELECT row_number() OVER (ORDER BY from_id, to_id, use, path, line, test) AS ref_ord, r.*, CAST(1 + line % 3 AS INT) AS col FROM refs r",
    "opaque": "SELECT concat('c', c_custkey) AS id FROM customer WHERE c_custkey % 13 = 0",
    "schema_reads": "SELECT concat('p', p_partkey) AS from_id, concat('p', CAST(floor(p_partkey / 4) AS BIGINT) + p_size) AS to_id FROM part",
    "member_reads": "SELECT concat('c', o_custkey) AS from_id, concat('slim', o_orderkey) AS member FROM orders UNION ALL SELECT concat('o', o_orderkey), concat('wide', o_orderkey) FROM orders",
    "dir_peers": "SELECT DISTINCT m.dir, m.name, concat('pkg', (n_nationkey * 3 + 2) % 25) AS peer FROM manifests m JOIN nation ON m.name = concat('pkg', n_nationkey)",
    "dir_needed": "SELECT DISTINCT dir, name FROM manifests WHERE name IN ('pkg1', 'pkg4', 'pkg17')",
    "glob_rows": """
        SELECT concat('w', o_orderkey) AS pattern, CAST(o_orderkey % 6 AS INT) AS shape, o_custkey % 45 AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'app' WHEN o_orderkey % 6 = 5 THEN 'lib' ELSE '' END AS base,
        CASE o_orderkey % 6 WHEN 0 THEN concat('m', o_custkey % 45, '.ts') WHEN 1 THEN concat('**/l', o_custkey % 45, '.{ts,tsx}') WHEN 2 THEN concat('app/[lm]', o_custkey % 45, '.ts') WHEN 3 THEN concat('{app,src}/*', o_custkey % 45, '.*')
        WHEN 4 THEN concat('src/**/n', o_custkey % 45, '*') ELSE concat('*#', o_custkey % 45 % 10, '*') END AS glob FROM orders""",
    "tool_files": """
        SELECT concat('pk', o_custkey % 30, CASE WHEN o_custkey % 4 = 0 THEN '/src' ELSE '' END, CASE o_orderkey % 7 WHEN 0 THEN '/app' WHEN 1 THEN '/pages' WHEN 2 THEN '/app/pages' WHEN 3 THEN '/__tests__' WHEN 4 THEN '/.next/cache' ELSE '/lib' END,
        CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('/d', o_orderkey % 50) ELSE concat('/_d', o_orderkey % 50) END, '/', CASE o_totalprice > 150000 WHEN true THEN 'page' ELSE concat(CASE WHEN o_orderstatus = 'F' THEN '_o' ELSE 'o' END, o_orderkey) END,
        CASE o_orderpriority WHEN '1-URGENT' THEN '.ts' WHEN '2-HIGH' THEN '.tsx' WHEN '3-MEDIUM' THEN '.test.js' WHEN '4-NOT SPECIFIED' THEN '.vue' ELSE '.astro' END) AS path FROM orders""",
    "installed_tools": """
        SELECT DISTINCT concat('pk', c_custkey % 30) AS dir, CASE c_custkey % 4 WHEN 0 THEN 'next' WHEN 1 THEN 'astro' WHEN 2 THEN 'nuxt' ELSE 'jest' END AS name,
        concat(CASE c_custkey % 4 WHEN 0 THEN 12 + c_custkey % 30 % 6 WHEN 1 THEN 4 + c_custkey % 30 % 5 WHEN 2 THEN 2 + c_custkey % 30 % 4 ELSE 28 + c_custkey % 30 % 3 END, '.', c_custkey % 30 % 7, '.1') AS version FROM customer""",
    "surface_symbols": """
        SELECT concat('f', n_nationkey) AS id, 'file' AS kind, '' AS parent, concat('s/', n_nationkey, '.ts') AS path, n_name AS name, false AS exported, 'public' AS visibility, false AS type_only, false AS global_block FROM nation
        UNION ALL SELECT concat('g', r_regionkey), 'namespace', concat('f', r_regionkey), concat('s/', r_regionkey, '.ts'), 'global', false, 'public', false, true FROM region
        UNION ALL SELECT concat('gm', n_nationkey), CASE WHEN n_nationkey % 4 = 3 THEN 'type-parameter' ELSE 'variable' END, concat('g', n_regionkey), concat('s/', n_regionkey, '.ts'), concat('held', n_nationkey), n_nationkey % 3 = 0, 'public', false, false FROM nation
        UNION ALL SELECT concat('c', c_custkey), CASE c_custkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'namespace' WHEN 3 THEN 'function' ELSE 'type' END, concat('f', c_nationkey), concat('s/', c_nationkey, '.ts'), concat('type', c_custkey % 500), c_acctbal > 0, 'public', false, false FROM customer
        UNION ALL SELECT concat('p', p_partkey), CASE p_partkey % 6 WHEN 0 THEN 'type-parameter' WHEN 1 THEN 'method' ELSE 'class-member' END, concat('c', c_custkey), concat('s/', c_nationkey, '.ts'), concat('member', p_partkey % 90), p_size % 3 > 0, CASE p_size % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'private-name' WHEN 2 THEN 'protected' ELSE 'public' END, p_size % 10 = 8, false FROM part CROSS JOIN (SELECT count(*) AS n FROM customer) z JOIN customer ON p_partkey % z.n = c_custkey""",
    "surface_uses": """
        SELECT concat('p', p_partkey) AS from_id, CASE WHEN p_size % 9 = 5 THEN NULL ELSE concat('c', (p_partkey * 7 + p_size) % (SELECT count(*) FROM customer)) END AS to_id, concat('type', p_partkey % 700) AS name FROM part WHERE p_size % 3 = 1
        UNION ALL SELECT concat('f', n_nationkey), concat('c', n_nationkey * 31), 'type' FROM nation
        UNION ALL SELECT concat('c', s_suppkey * 2), concat('gm', s_nationkey), 'held' FROM supplier""",
    "surface_inferred": "SELECT concat('c', s_suppkey * 3) AS from_id, concat('p', s_suppkey * 5) AS to_id, s_acctbal > 0 AS member FROM supplier",
    "surface_published": "SELECT concat('f', n_nationkey) AS id FROM nation WHERE n_regionkey = 2",
    "surface_exports": "SELECT concat('f', c_nationkey) AS file, concat('c', c_custkey) AS id FROM customer WHERE c_acctbal > 8000",
    "surface_statements": "SELECT concat('c', o_custkey) AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('/** Made by ', o_orderstatus, ' @beta */') WHEN 1 THEN '/** @public */ /** later */' WHEN 2 THEN '/* @public */' WHEN 3 THEN '/** @publicly */' ELSE '' END AS leading FROM orders WHERE o_totalprice > 400000",
    "json_docs": """
        SELECT concat('pk', c_custkey, '/package.json') AS path, concat('{', chr(10), '  "name": "', CASE WHEN c_custkey % 5 = 0 THEN concat('\U0001f600', c_name) ELSE c_name END, '", "dependencies": {', CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE '' END, '"dep', c_custkey % 40, '": "^1.', c_custkey, '.0",', CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE ' ' END,
        '"@s/lib', c_nationkey, '": "*"},', CASE WHEN c_custkey % 7 = 0 THEN concat(chr(13), chr(10)) ELSE chr(9) END, '"devDependencies" : { "dev', c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN '" "~2"' ELSE '" : "~2"' END, ' } }') AS text FROM customer""",
    "edge_sides": "SELECT concat('e', p_partkey % 700) AS edge, CASE WHEN p_partkey % 2 = 0 THEN 'provides' ELSE 'used_by' END AS side, concat('p', p_partkey * 2) AS symbol FROM part",
}


def _needs(name: str) -> list[str]:
    return [f for f in FACTS if f != name and re.search(rf"\b{f}\b", FACTS[name])]


def order_of(names: list[str]) -> list[str]:
    """``names`` and the facts they are made of, each after what it needs."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in _needs(name):
            add(other)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fact table over the tables of ``sf_dir``."""
    text, args = FACTS[name], {}
    for other in TABLES:
        if re.search(rf"\b(FROM|JOIN) {other}\b", text):
            args[other] = spark.read.parquet(f"{sf_dir}/{other}.parquet")
    for other in _needs(name):
        args[other] = fact(spark, sf_dir, other)
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in args else m[0], text.replace("{", "{{").replace("}", "}}")), **args)


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named facts for SQL."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({FACTS[n]})" for n in order_of(list(names)))
