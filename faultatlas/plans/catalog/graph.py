"""Queries over the code graph: extraction, resolution, traversal, map."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultatlas.operators import cycles, graph, impact, python_source, reach, repo_map, resolution, text_patterns
from faultatlas.plans.catalog import sql, views
from faultatlas.plans.catalog.registry import query, table
from faultatlas.plans.layout import cut
from faultatlas.plans.repository_map import file_report


def _parsed(spark, sf_dir):
    return cut(python_source.parse_python(views.code_files(spark, sf_dir)))


def _graph(spark, sf_dir):
    """The graph of the generated sources; the files are a stored table, as in use."""
    return graph.build_graph(cut(views.code_files(spark, sf_dir)))


# ---------------------------------------------------------------- extraction

_SYMBOLS_SQL = f"""WITH {sql.FILE_DEPS},
n AS (SELECT f.k, f.path, count(d.dst) AS imports FROM files f LEFT JOIN deps d ON d.src = f.k GROUP BY 1, 2),
p AS (SELECT n.*, p_size, p_type, imports + (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)
        + (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) + 1 AS def_line,
        (CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END)
        + (CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) + 1 AS body
      FROM n JOIN part ON p_partkey = k WHERE k % 97 <> 5),
s AS (
  SELECT path AS file, concat('f_', {sql.stem('k')}) AS qualified_name, 'Function' AS kind, def_line AS line_start, def_line + body AS line_end,
         CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS complexity,
         concat('def f_', {sql.stem('k')}, '(v):') AS signature,
         CASE WHEN k % 5 = 0 THEN concat('app.get(''/', p_type, '/', CAST(p_size AS VARCHAR), ''')') ELSE '' END AS decorators,
         CAST(NULL AS VARCHAR) AS bases, CAST(NULL AS VARCHAR) AS methods
  FROM p
  UNION ALL SELECT path, concat('C_', {sql.stem('k')}), 'Class', def_line + body + 1, def_line + body + 5, NULL, NULL, NULL, 'Base', 'run>step'
  FROM p WHERE k % 11 = 0
  UNION ALL SELECT path, concat('C_', {sql.stem('k')}, '.run'), 'Function', def_line + body + 2, def_line + body + 3, 1, '    def run(self, v):', '', NULL, NULL
  FROM p WHERE k % 11 = 0
  UNION ALL SELECT path, concat('C_', {sql.stem('k')}, '.step'), 'Function', def_line + body + 4, def_line + body + 5, 1, '    def step(self, v):', '', NULL, NULL
  FROM p WHERE k % 11 = 0)
"""


@query("parse_symbols", _SYMBOLS_SQL + """SELECT file, qualified_name, kind, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end,
  CAST(complexity AS BIGINT) AS complexity, signature, decorators, bases, methods FROM s""")
def parse_symbols(spark, sf_dir):
    found = python_source.symbols(python_source.parse_python(views.code_files(spark, sf_dir)))
    return found.select(
        "file", "qualified_name", "kind",
        *[F.col(c).cast("bigint").alias(c) for c in ("line_start", "line_end", "complexity")],
        "signature",
        *[F.array_join(c, ">").alias(c) for c in ("decorators", "bases", "methods")],
    )


@query("function_metrics", _SYMBOLS_SQL + """SELECT file, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total_complexity,
  CAST(max(complexity) AS BIGINT) AS max_complexity, CAST(max(line_end - line_start + 1) AS BIGINT) AS longest_function
FROM s WHERE kind = 'Function' GROUP BY file""")
def function_metrics(spark, sf_dir):
    parsed = python_source.parse_python(views.code_files(spark, sf_dir))
    measures = ("functions", "total_complexity", "max_complexity", "longest_function")
    return python_source.function_metrics(parsed).select("file", *[F.col(c).cast("bigint").alias(c) for c in measures])


@query("syntax_errors", f"""WITH {sql.CODE_EDGES},
n AS (SELECT p_partkey AS k, p_size, count(dst) AS imports FROM part LEFT JOIN code_edges ON src = p_partkey WHERE p_partkey % 97 = 5 GROUP BY 1, 2),
p AS (SELECT k, imports + (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)
        + (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) + 1 + (CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END)
        + (CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) + 1
        + (CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END) + 1 AS line FROM n)
SELECT {sql.path('k')} AS file_path, CAST(line AS BIGINT) AS line_number, 'functional_bug' AS issue_class, 'high' AS severity,
  'Python syntax error: invalid syntax' AS title, 'def broken(:' AS code_snippet, 'repo_mapper:ast' AS tool_source,
  concat('`', {sql.path('k')}, '` fails to parse (line ', CAST(line AS VARCHAR), '): invalid syntax. The module cannot be imported or executed until this is fixed.', chr(10), chr(10), '    def broken(:') AS description
FROM p""")
def syntax_errors(spark, sf_dir):
    found = python_source.syntax_errors(python_source.parse_errors(views.code_files(spark, sf_dir)))
    return found.select(
        "file_path", F.col("line_number").cast("bigint").alias("line_number"), "issue_class", "severity",
        "title", "code_snippet", "tool_source", "description",
    )


@query("module_index", f"""WITH {sql.FILE_DEPS}, keys AS (
  SELECT path, concat(service_boundary, '.', {sql.stem('k')}) AS key FROM files
  UNION ALL SELECT path, {sql.stem('k')} FROM files)
SELECT key, min(path) AS target FROM keys GROUP BY key""")
def module_index(spark, sf_dir):
    return resolution.module_index(views.file_names(spark, sf_dir)).select("key", "target")


@query("import_refs", f"""WITH {sql.FILE_DEPS},
r AS (
  SELECT consumer AS file, concat({sql.folder('dst')}, '.', {sql.stem('dst')}) AS candidate,
         CASE WHEN dst % 4 = 1 THEN concat('a_', {sql.stem('dst')}) ELSE concat('f_', {sql.stem('dst')}) END AS alias,
         CASE WHEN dst % 4 = 1 THEN concat({sql.folder('dst')}, '.', {sql.stem('dst')})
              ELSE concat({sql.folder('dst')}, '.', {sql.stem('dst')}, '.f_', {sql.stem('dst')}) END AS dotted FROM deps
  UNION ALL
  SELECT consumer, concat({sql.folder('dst')}, '.', {sql.stem('dst')}, '.f_', {sql.stem('dst')}),
         concat('f_', {sql.stem('dst')}), concat({sql.folder('dst')}, '.', {sql.stem('dst')}, '.f_', {sql.stem('dst')})
  FROM deps WHERE dst % 4 <> 1
  UNION ALL SELECT path, 'os', 'os', 'os' FROM files WHERE k % 3 = 0 AND k % 97 <> 5
  UNION ALL SELECT path, 'json.decoder', 'jd', 'json.decoder' FROM files WHERE k % 4 = 0 AND k % 97 <> 5)
SELECT * FROM r""")
def import_refs(spark, sf_dir):
    refs = resolution.import_refs(python_source.parse_python(views.code_files(spark, sf_dir)))
    return refs.select("file", "candidate", "alias", "dotted")


@query("resolved_imports", f"WITH {sql.FILE_DEPS} SELECT consumer AS file, dependency AS target, CAST(0 AS BIGINT) AS dropped FROM deps")
def resolved_imports(spark, sf_dir):
    refs = resolution.import_refs(_parsed(spark, sf_dir))
    index = resolution.module_index(views.file_names(spark, sf_dir))
    return resolution.resolve_imports(refs, index).select("file", "target", F.col("dropped").cast("bigint").alias("dropped"))


@query("external_modules", f"""WITH {sql.FILE_DEPS}, m AS (
  SELECT consumer AS file, concat('MOD:', {sql.folder('dst')}) AS module_id FROM deps
  UNION SELECT path, 'MOD:os' FROM files WHERE k % 3 = 0 AND k % 97 <> 5
  UNION SELECT path, 'MOD:json' FROM files WHERE k % 4 = 0 AND k % 97 <> 5)
SELECT file, module_id FROM m""")
def external_modules(spark, sf_dir):
    parsed = python_source.parse_python(views.code_files(spark, sf_dir))
    return resolution.external_modules(parsed).select("file", "module_id")


_CALLS = f"""calls AS (
  SELECT src, consumer AS file, {sql.symbol('src')} AS caller_id,
         CASE WHEN dst % 97 = 5 THEN dependency ELSE {sql.symbol('dst')} END AS target, dependency AS target_file
  FROM deps WHERE (src + dst) % 3 <> 0
  UNION ALL
  SELECT k, path, concat(path, '::C_', {sql.stem('k')}, '.run'), concat(path, '::C_', {sql.stem('k')}, '.step'), path
  FROM files WHERE k % 11 = 0 AND k % 97 <> 5)"""


@query("resolved_calls", f"WITH {sql.FILE_DEPS}, {_CALLS} SELECT file, caller_id, target, target_file FROM calls")
def resolved_calls(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    edges, _ = resolution.resolve_calls(
        resolution.call_refs(parsed),
        python_source.symbols(parsed),
        resolution.module_index(views.file_names(spark, sf_dir)),
    )
    return edges.select("file", "caller_id", "target", "target_file").distinct()


@query("unresolved_calls", f"""WITH {sql.FILE_DEPS}
SELECT path AS file, {sql.symbol('k')} AS caller_id, 'session.query' AS call FROM files WHERE k % 6 = 0 AND k % 97 <> 5
UNION ALL SELECT path, {sql.symbol('k')}, 'os.environ.get' FROM files WHERE k % 7 = 0 AND k % 97 <> 5
UNION ALL SELECT path, {sql.symbol('k')}, 'app.get' FROM files WHERE k % 5 = 0 AND k % 97 <> 5""")
def unresolved_calls(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    _, missed = resolution.resolve_calls(
        resolution.call_refs(parsed),
        python_source.symbols(parsed),
        resolution.module_index(views.file_names(spark, sf_dir)),
    )
    return missed.select("file", "caller_id", F.array_join("chain", ".").alias("call"))


@query("c_includes", """WITH c AS (
  SELECT concat('src/p', p_partkey, '.c') AS file, concat('inc/p', p_size, '.h') AS target FROM part
  UNION SELECT concat('src/p', p_partkey, '.c'), concat('src/p', p_size, '.c') FROM part WHERE p_size <> p_partkey)
SELECT DISTINCT c.file, c.target FROM c""")
def c_includes(spark, sf_dir):
    files = views.c_files(spark, sf_dir)
    return text_patterns.resolve_c_includes(text_patterns.scan_text(files), files).select("file", "target")


@query("routes", f"""SELECT {sql.path('p_partkey')} AS file, concat('API:/', p_type, '/', CAST(p_size AS VARCHAR), ':GET') AS endpoint_id,
  concat('/', p_type, '/', CAST(p_size AS VARCHAR)) AS route, 'GET' AS method FROM part WHERE p_partkey % 5 = 0""")
def routes(spark, sf_dir):
    return text_patterns.extract_routes(text_patterns.scan_text(views.code_files(spark, sf_dir))).drop("repo_key")


@query("db_refs", f"""SELECT {sql.path('p_partkey')} AS file, concat('DB:', replace(p_brand, '#', '')) AS model_id,
  CASE WHEN p_partkey % 97 <> 5 THEN {sql.symbol('p_partkey')} END AS function_id FROM part WHERE p_partkey % 6 = 0""")
def db_refs(spark, sf_dir):
    files = cut(views.code_files(spark, sf_dir))
    symbols = python_source.symbols(python_source.parse_python(files))
    return text_patterns.extract_db_refs(text_patterns.scan_text(files), symbols).select("file", "model_id", "function_id")


@query("config_refs", f"""SELECT {sql.path('p_partkey')} AS file, concat('CFG:K', CAST(p_size AS VARCHAR)) AS config_id FROM part WHERE p_partkey % 7 = 0""")
def config_refs(spark, sf_dir):
    return text_patterns.extract_config_refs(text_patterns.scan_text(views.code_files(spark, sf_dir))).select("file", "config_id")


# ------------------------------------------------------------ the whole graph

_EDGES = f"""{sql.FILE_DEPS}, {_CALLS},
edges AS (
  SELECT path AS src, service_boundary AS dst, 'BELONGS_TO' AS edge_type, CAST(NULL AS VARCHAR) AS confidence, path AS src_file, 'ServiceBoundary' AS dst_type FROM files
  UNION ALL SELECT path, {sql.symbol('k')}, 'DEFINES', NULL, path, 'Function' FROM files WHERE k % 97 <> 5
  UNION ALL SELECT path, concat(path, '::C_', {sql.stem('k')}, s), 'DEFINES', NULL, path, CASE WHEN s = '' THEN 'Class' ELSE 'Function' END
    FROM files, (VALUES (''), ('.run'), ('.step')) v(s) WHERE k % 11 = 0 AND k % 97 <> 5
  UNION ALL SELECT DISTINCT consumer, concat('MOD:', {sql.folder('dst')}), 'IMPORTS', NULL, consumer, 'Module' FROM deps
  UNION ALL SELECT path, 'MOD:os', 'IMPORTS', NULL, path, 'Module' FROM files WHERE k % 3 = 0 AND k % 97 <> 5
  UNION ALL SELECT path, 'MOD:json', 'IMPORTS', NULL, path, 'Module' FROM files WHERE k % 4 = 0 AND k % 97 <> 5
  UNION ALL SELECT consumer, dependency, CASE WHEN src % 10 = 0 THEN 'TESTS' ELSE 'IMPORTS' END, NULL, consumer, 'File' FROM deps
  UNION ALL SELECT caller_id, target, 'CALLS', 'high', file, CASE WHEN target = target_file THEN 'File' ELSE 'Function' END FROM calls
  UNION ALL SELECT {sql.path('p_partkey')}, concat('API:/', p_type, '/', CAST(p_size AS VARCHAR), ':GET'), 'SERVES_API', NULL, {sql.path('p_partkey')}, 'APIEndpoint' FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT {sql.symbol('p_partkey')}, concat('DB:', replace(p_brand, '#', '')), 'QUERIES_DB', 'high', {sql.path('p_partkey')}, 'DBModel' FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 97 <> 5
  UNION ALL SELECT {sql.path('p_partkey')}, concat('CFG:K', CAST(p_size AS VARCHAR)), 'USES_CONFIG', NULL, {sql.path('p_partkey')}, 'ConfigVar' FROM part WHERE p_partkey % 7 = 0),
nodes AS (
  SELECT path AS node_id, 'File' AS node_type FROM files
  UNION ALL SELECT DISTINCT service_boundary, 'ServiceBoundary' FROM files
  UNION ALL SELECT DISTINCT dst, dst_type FROM edges WHERE dst_type IN ('Class', 'Module', 'APIEndpoint', 'ConfigVar')
  UNION ALL SELECT dst, dst_type FROM edges WHERE edge_type = 'DEFINES' AND dst_type = 'Function'
  UNION ALL SELECT DISTINCT concat('DB:', replace(p_brand, '#', '')), 'DBModel' FROM part WHERE p_partkey % 6 = 0)"""


@query("graph_edges", f"WITH {_EDGES} SELECT src, dst, edge_type, confidence, src_file, dst_type FROM edges")
def graph_edges(spark, sf_dir):
    built = _graph(spark, sf_dir)
    return built.edges.select("src", "dst", "edge_type", "confidence", "src_file", "dst_type")


@query("graph_nodes", f"WITH {_EDGES} SELECT node_id, node_type FROM nodes")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.select("node_id", "node_type")


@query("test_edges", f"WITH {_EDGES} SELECT src, dst FROM edges WHERE edge_type = 'TESTS'")
def test_edges(spark, sf_dir):
    refs = resolution.import_refs(_parsed(spark, sf_dir))
    imports = resolution.resolve_imports(refs, resolution.module_index(views.file_names(spark, sf_dir)))
    edges = imports.select(
        "repo_key", F.col("file").alias("src"), F.col("target").alias("dst"), F.lit("IMPORTS").alias("edge_type"),
        F.lit(True).alias("resolved"), F.col("file").alias("src_file"), F.col("target").alias("dst_file"),
    )
    return resolution.retype_test_edges(edges).where("edge_type = 'TESTS'").select("src", "dst")


@query("graph_stats", f"""WITH {_EDGES},
c AS (SELECT 'node' AS element, node_type AS type, count(*) AS n FROM nodes GROUP BY ROLLUP (node_type)
  UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ROLLUP (edge_type))
SELECT * FROM c""")
def graph_stats(spark, sf_dir):
    built = _graph(spark, sf_dir)
    return graph.graph_stats(built.nodes, built.edges).select("element", "type", "n")


@query("file_dependencies", f"WITH {sql.FILE_DEPS} SELECT consumer, dependency, evidence FROM deps")
def file_dependencies(spark, sf_dir):
    built = _graph(spark, sf_dir)
    return graph.file_dependencies(built.edges).select("consumer", "dependency", "evidence")


# ---------------------------------------------------------------- traversals

@query("impact_paths", f"""WITH {sql.impact(3, "changed")}
SELECT root, node, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path, evidence FROM paths""")
def impact_paths(spark, sf_dir):
    """The paths from every file asked about to all that its change reaches."""
    paths = impact.impact_paths(cut(views.file_deps(spark, sf_dir)), views.changed_files(spark, sf_dir), hops=3, by_lists=True)
    return paths.select(
        "root", "node", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", ">").alias("path"), "evidence"
    )


_ANALYSIS = """analysis AS (
  SELECT f.path AS file,
    count(m.node) FILTER (WHERE NOT m.is_test) AS file_count,
    count(m.node) FILTER (WHERE NOT m.is_test AND m.depth = 1) AS direct_dependents,
    count(m.node) FILTER (WHERE m.is_test) AS related_tests,
    count(m.node) AS path_count,
    count(DISTINCT CASE WHEN NOT m.is_test THEN m.service_boundary END) AS module_count,
    (SELECT count(*) FROM deps d WHERE d.consumer = f.path) AS direct_dependencies,
    count(DISTINCT CASE WHEN NOT m.is_test AND m.service_boundary <> f.service_boundary THEN m.service_boundary END) + 1 AS boundary_count,
    coalesce(bool_or(m.evidence IN ('CALLS', 'TESTS')), false) AS strong
  FROM files f LEFT JOIN members m ON m.root = f.path GROUP BY f.path, f.service_boundary),
analysed AS (SELECT * EXCLUDE (strong), boundary_count > 1 AS crosses_service_boundary,
    CASE WHEN strong THEN 'high' WHEN path_count > 0 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN file_count <= 2 THEN 'narrow' WHEN file_count <= 8 THEN 'moderate' ELSE 'wide' END AS category
  FROM analysis)"""


def _bigints(df, *columns):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in columns else F.col(c) for c in df.columns])


@query("impact_summary", f"WITH {sql.impact(3)}, {_ANALYSIS} SELECT * FROM analysed")
def impact_summary(spark, sf_dir):
    deps = cut(views.file_deps(spark, sf_dir))
    analysed = reach.reach_summary(deps, views.file_names(spark, sf_dir), 3).drop("repo_key")
    return _bigints(analysed, "file_count", "direct_dependents", "related_tests", "path_count", "module_count",
                    "direct_dependencies", "boundary_count")


@query("impact_boundaries", f"""WITH {sql.impact(3)}
SELECT root AS file, service_boundary, is_test, count(*) AS files FROM members GROUP BY 1, 2, 3""")
def impact_boundaries(spark, sf_dir):
    """The boundaries that a change of each file crosses, as rows."""
    found = reach.impact_boundaries(cut(views.file_deps(spark, sf_dir)), 3)
    return found.groupBy("file", "service_boundary", "is_test").agg(F.sum("n").alias("files"))


@query("blast_radius", f"""WITH {sql.impact(2)}, {_ANALYSIS}, {_EDGES.replace(sql.FILE_DEPS + ', ', '')},
near AS (SELECT DISTINCT a.root, e.dst, e.dst_type FROM (
    SELECT path AS root, path AS file FROM files UNION ALL SELECT root, node FROM members WHERE NOT is_test) a
  JOIN edges e ON e.src_file = a.file WHERE e.dst_type IN ('Function', 'APIEndpoint', 'DBModel')),
counts AS (SELECT root, count(*) FILTER (WHERE dst_type = 'Function') AS function_count,
    count(*) FILTER (WHERE dst_type = 'APIEndpoint') AS api_count, count(*) FILTER (WHERE dst_type = 'DBModel') AS db_model_count FROM near GROUP BY root)
SELECT file, file_count, category, confidence, coalesce(function_count, 0) AS function_count, coalesce(api_count, 0) AS api_count,
  coalesce(db_model_count, 0) AS db_model_count FROM analysed LEFT JOIN counts ON root = file""")
def blast_radius(spark, sf_dir):
    """The whole way: sources, parse, graph, traversal, counts."""
    radius = file_report(cut(views.code_files(spark, sf_dir)), hops=2)
    return _bigints(
        radius.select("file", "file_count", "category", "confidence", "function_count", "api_count", "db_model_count"),
        "file_count", "function_count", "api_count", "db_model_count",
    )


@query("blast_members", f"""WITH {sql.impact(2, "changed")}, {_EDGES.replace(sql.FILE_DEPS + ', ', '')},
near AS (SELECT a.root, e.dst, e.dst_type, bool_and(e.edge_type = 'CALLS') AS is_callee FROM (
    SELECT file AS root, file FROM changed UNION ALL SELECT root, node FROM members WHERE NOT is_test) a
  JOIN edges e ON e.src_file = a.file WHERE e.dst_type IN ('Function', 'APIEndpoint', 'DBModel') GROUP BY ALL)
SELECT root AS file, dst AS node_id, dst_type AS node_type, is_callee FROM near""")
def blast_members(spark, sf_dir):
    """What lies in the blast radius of the files asked about, one row each."""
    built = _graph(spark, sf_dir)
    deps, asked = cut(graph.file_dependencies(built.edges)), cut(views.changed_files(spark, sf_dir))
    members = impact.impact_members(impact.impact_paths(deps, asked, 2))
    return impact.blast_members(members, built.files, built.edges, asked).drop("repo_key")


@query("neighbours", f"""WITH {sql.FILE_DEPS}, u AS (
  SELECT DISTINCT consumer AS a, dependency AS b FROM deps UNION SELECT dependency, consumer FROM deps),
h1 AS (SELECT a AS seed, b AS node FROM u),
h2 AS (SELECT DISTINCT h1.seed, u.b AS node FROM h1 JOIN u ON u.a = h1.node
       WHERE u.b <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = u.b))
SELECT seed, node, CAST(1 AS BIGINT) AS distance FROM h1 UNION ALL SELECT seed, node, CAST(2 AS BIGINT) FROM h2""")
def neighbours(spark, sf_dir):
    deps = cut(views.file_deps(spark, sf_dir))
    edges = deps.select("repo_key", F.col("consumer").alias("src"), F.col("dependency").alias("dst"))
    seeds = views.file_names(spark, sf_dir).select("repo_key", F.col("path").alias("node_id"))
    near = graph.neighbours(edges, seeds, hops=2)
    return near.select("seed", "node", F.col("distance").cast("bigint").alias("distance"))


@query("related_files", f"""WITH {sql.impact(3)}, places AS (
  SELECT consumer AS file, dependency AS related, 0 AS g, 0 AS depth, [dependency] AS key FROM deps
  UNION ALL SELECT root, node, 1, 0, [node] FROM members WHERE NOT is_test AND depth = 1
  UNION ALL SELECT root, node, 2, 0, [node] FROM members WHERE is_test
  UNION ALL SELECT root, node, 3, depth, path FROM members WHERE NOT is_test AND depth > 1),
best AS (SELECT file, related, min(row(g, depth, key)) AS place FROM places WHERE file <> related GROUP BY 1, 2),
ranked AS (SELECT file, related, row_number() OVER (PARTITION BY file ORDER BY place, related) AS position FROM best)
SELECT file, CAST(position AS BIGINT) AS position, related FROM ranked WHERE position <= 6""")
def related_files(spark, sf_dir):
    related = impact.related_files(cut(views.file_deps(spark, sf_dir)), views.file_names(spark, sf_dir))
    return _bigints(related.drop("repo_key"), "position")


@query("context_summary", _SYMBOLS_SQL.replace(f"WITH {sql.FILE_DEPS}", f"WITH {sql.impact(3)}") + """,
x AS (SELECT f.path AS file,
  (SELECT string_agg(qualified_name, ', ' ORDER BY qualified_name) FROM s WHERE s.file = f.path AND s.kind = 'Function') AS symbols,
  (SELECT string_agg(dependency, ', ' ORDER BY dependency) FROM (SELECT consumer, dependency, row_number() OVER (PARTITION BY consumer ORDER BY dependency) AS rn FROM deps) WHERE consumer = f.path AND rn <= 8) AS dependencies,
  (SELECT string_agg(node, ', ' ORDER BY node) FROM (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY node) AS rn FROM members WHERE NOT is_test AND depth = 1) WHERE root = f.path AND rn <= 8) AS dependents,
  (SELECT string_agg(node, ', ' ORDER BY node) FROM (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY node) AS rn FROM members WHERE is_test) WHERE root = f.path AND rn <= 8) AS tests
  FROM files f)
SELECT file, concat('Defined symbols: ', coalesce(symbols, 'none'), chr(10), 'Direct dependencies: ', coalesce(dependencies, 'none'), chr(10),
  'Direct dependents: ', coalesce(dependents, 'none'), chr(10), 'Related tests: ', coalesce(tests, 'none')) AS summary FROM x""")
def context_summary(spark, sf_dir):
    symbols = python_source.symbols(_parsed(spark, sf_dir))
    return impact.context_summary(views.file_names(spark, sf_dir), symbols, cut(views.file_deps(spark, sf_dir))).drop("repo_key")


# Places to trace: one per lineitem row.
_FLOW_REQUESTS = f"""requests AS (SELECT DISTINCT {sql.path('l_partkey')} AS file, CASE WHEN l_linenumber < 7 THEN l_linenumber * 2 END AS line FROM lineitem)"""


@query("data_flow", _SYMBOLS_SQL + f""", {_CALLS}, {_FLOW_REQUESTS},
links AS (SELECT caller_id AS a, target AS b, 'CALLS' AS t FROM calls
  UNION ALL SELECT {sql.symbol('p_partkey')}, concat('DB:', replace(p_brand, '#', '')), 'QUERIES_DB' FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 97 <> 5),
fn AS (SELECT file, concat(file, '::', qualified_name) AS id, line_start, line_end FROM s WHERE kind = 'Function'),
hit AS (SELECT r.file, r.line, fn.id FROM requests r JOIN fn ON fn.file = r.file AND (r.line IS NULL OR r.line BETWEEN fn.line_start AND fn.line_end)),
entries AS (SELECT * FROM hit UNION ALL
  SELECT r.file, r.line, fn.id FROM requests r JOIN fn ON fn.file = r.file
  WHERE r.line IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.file = r.file AND h.line = r.line)),
o AS (SELECT file, line, 'entry' AS role, id AS node_id FROM entries
  UNION SELECT e.file, e.line, 'caller', l.a FROM entries e JOIN links l ON l.b = e.id AND l.t = 'CALLS'
  UNION SELECT e.file, e.line, 'callee', l.b FROM entries e JOIN links l ON l.a = e.id
  UNION SELECT r.file, r.line, 'file_dependency', d.dependency FROM requests r JOIN deps d ON d.consumer = r.file
  UNION SELECT r.file, r.line, 'file_dependent', d.consumer FROM requests r JOIN deps d ON d.dependency = r.file WHERE NOT {sql.is_test('d.consumer')})
SELECT file, CAST(line AS BIGINT) AS line, role, node_id FROM o""")
def data_flow(spark, sf_dir):
    built = _graph(spark, sf_dir)
    line = F.col("l_linenumber")
    requests = table(spark, sf_dir, "lineitem").select(
        F.lit(views.REPO).alias("repo_key"),
        views.path_of(F.col("l_partkey")).alias("file"),
        F.when(line < 7, line * 2).alias("line"),
    )
    flow = impact.trace_data_flow(requests, built.symbols, built.edges, graph.file_dependencies(built.edges))
    return _bigints(flow.drop("repo_key"), "line")


@query("circular_dependencies", f"""WITH {sql.FILE_DEPS}, e AS (SELECT consumer AS a, dependency AS b FROM deps),
c AS (
  SELECT [x.a, x.b] AS cycle FROM e x JOIN e y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b
  UNION ALL
  SELECT [x.a, x.b, y.b] FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b
  UNION ALL
  SELECT [x.a, x.b, y.b, z.b] FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b JOIN e w ON w.a = z.b AND w.b = x.a
  WHERE x.a < x.b AND x.a < y.b AND x.a < z.b AND x.b <> y.b AND x.b <> z.b AND y.b <> z.b)
SELECT array_to_string(cycle, ' -> ') AS chain, CAST(len(cycle) AS BIGINT) AS length FROM (
  SELECT cycle, row_number() OVER (ORDER BY len(cycle), cycle) AS rn FROM c) WHERE rn <= 10""")
def circular_dependencies(spark, sf_dir):
    found = graph.circular_dependencies(views.file_deps(spark, sf_dir))
    return found.select(F.array_join("cycle", " -> ").alias("chain"), F.col("length").cast("bigint").alias("length"))


# Per service boundary, the files whose uses lead around inside it; the boundary is the repository.
_INSIDE = f"""WITH RECURSIVE {sql.FILE_DEPS},
inside AS MATERIALIZED (SELECT {sql.boundary('consumer')} AS repo_key, consumer AS a, dependency AS b FROM deps
  WHERE {sql.boundary('consumer')} = {sql.boundary('dependency')}),
walk(a, b) AS (SELECT a, b FROM inside UNION SELECT w.a, i.b FROM walk w JOIN inside i ON i.a = w.b)"""


@query("cycle_components", f"""{_INSIDE}
SELECT {sql.boundary('x.a')} AS repo_key, least(x.a, min(x.b)) AS component, x.a AS file
FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a""")
def cycle_components(spark, sf_dir):
    deps = views.file_deps(spark, sf_dir).withColumn("repo_key", F.substring_index("consumer", "/", 1))
    return cycles.cycle_components(deps.where(F.substring_index("dependency", "/", 1) == F.col("repo_key")))


_CYCLES = f"""{sql.FILE_DEPS}, e AS (SELECT consumer AS a, dependency AS b FROM deps),
c AS (SELECT [x.a, x.b] AS cycle FROM e x JOIN e y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b)"""


@query("cycle_findings", f"""WITH {_CYCLES}
SELECT 'code_quality' AS issue_class, 'medium' AS severity, 'Circular dependency detected' AS title,
  concat('Files form a circular import chain: ', array_to_string(cycle, ' -> ')) AS description, cycle[1] AS file_path,
  'repo_mapper' AS tool_source, substr(sha256(concat('main|', array_to_string(cycle, '|'))), 1, 16) AS finding_id
FROM (SELECT cycle, row_number() OVER (ORDER BY cycle) AS rn FROM c) WHERE rn <= 10""")
def cycle_findings(spark, sf_dir):
    """Findings of the first cycles; the given tables have more than ten of two files at every scale."""
    found = cycles.findings_of_cycles(views.file_deps(spark, sf_dir))
    return found.select("issue_class", "severity", "title", "description", "file_path", "tool_source", "finding_id")


# ------------------------------------------------------------------- the map

_MAP = f"""{_EDGES},
shown AS (SELECT path, service_boundary, is_test FROM (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM files) WHERE rn <= 400),
touch AS (SELECT DISTINCT * FROM (
  SELECT dst AS connector, src AS path FROM edges WHERE src IN (SELECT path FROM shown) AND dst NOT IN (SELECT path FROM shown)
  UNION ALL SELECT src, dst FROM edges WHERE dst IN (SELECT path FROM shown) AND src NOT IN (SELECT path FROM shown))),
fit AS (SELECT connector FROM touch GROUP BY connector HAVING count(*) BETWEEN 2 AND 25),
pairs AS (
  SELECT src AS x, dst AS y, 3 AS w FROM edges WHERE edge_type IN ('IMPORTS', 'TESTS') AND src IN (SELECT path FROM shown) AND dst IN (SELECT path FROM shown)
  UNION ALL SELECT a.path, b.path, 1 FROM touch a JOIN touch b ON a.connector = b.connector AND a.path < b.path WHERE a.connector IN (SELECT connector FROM fit)),
links AS (SELECT x, y, weight FROM (SELECT x, y, CAST(sum(w) AS BIGINT) AS weight, row_number() OVER (ORDER BY sum(w) DESC, x, y) AS rn FROM pairs GROUP BY x, y) WHERE rn <= 1500)"""


@query("map_edges", f"WITH {_MAP} SELECT x, y, weight FROM links")
def map_edges(spark, sf_dir):
    built = _graph(spark, sf_dir)
    links = repo_map.map_edges(built.edges, repo_map.shown_files(views.file_names(spark, sf_dir)))
    return _bigints(links.select("x", "y", "weight"), "weight")


@query("map_nodes", f"""WITH {sql.FILE_DEPS}
SELECT path AS id, split_part(path, '/', 2) AS label, concat(path, '  ·  python') AS title, service_boundary AS "group",
  CAST(greatest(p_size * 100, 1) AS BIGINT) AS value, (SELECT count(*) FROM files) > 400 AS truncated
FROM (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM files) JOIN part ON p_partkey = k WHERE rn <= 400""")
def map_nodes(spark, sf_dir):
    return repo_map.map_nodes(views.file_names(spark, sf_dir)).drop("repo_key")


@query("map_blast", f"""WITH {sql.impact(2)}, shown AS (SELECT path, is_test FROM (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM files) WHERE rn <= 400)
SELECT root AS file, node AS affected FROM members WHERE NOT is_test AND root IN (SELECT path FROM shown) AND node IN (SELECT path FROM shown)""")
def map_blast(spark, sf_dir):
    shown = repo_map.shown_files(views.file_names(spark, sf_dir))
    return repo_map.map_blast(cut(views.file_deps(spark, sf_dir)), shown).drop("repo_key")


@query("map_stats", f"""WITH {_MAP}
SELECT (SELECT count(*) FROM shown) AS files, (SELECT count(*) FROM links) AS edges, (SELECT count(DISTINCT service_boundary) FROM shown) AS boundaries,
  (SELECT count(*) FROM files) > 400 AS truncated, (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, CAST(2 AS BIGINT) AS hops""")
def map_stats(spark, sf_dir):
    built = _graph(spark, sf_dir)
    names = views.file_names(spark, sf_dir)
    shown = repo_map.shown_files(names)
    links = repo_map.map_edges(built.edges, shown)
    stats = repo_map.map_stats(names, built.nodes, built.edges, shown, links)
    return _bigints(stats.drop("repo_key"), "hops")
