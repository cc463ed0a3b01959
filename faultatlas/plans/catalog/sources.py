"""Queries over corpora and tool reports (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultatlas.operators import graph
from faultatlas.operators.findings import map_model_findings
from faultatlas.plans.catalog import sql, views
from faultatlas.plans.catalog.registry import query, table
from faultatlas.plans.layout import checkpoint_folder
from faultatlas.sources import files as file_source
from faultatlas.sources import reports, tables


def _repo() -> Column:
    return F.lit(views.REPO).alias("repo_key")


def _file() -> Column:
    return views.path_of(F.col("l_partkey"))


# A tree with hidden, skipped, vendored and ordinary folders, by part size.
_FOLDERS = ["", "lib/", "lib/core/", ".git/", "lib/.cache/", "venv/", "web/node_modules/x/", "build/", ".github", "my venv/"]
_NAMES = [".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".cc", ".hh", ".md", "", ".PY"]


def _tree(spark, sf_dir):
    def pick(values: list[str], by: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))

    key = F.col("p_partkey")
    path = F.concat(pick(_FOLDERS, F.col("p_size")), F.lit("f"), key.cast("string"), pick(_NAMES, key))
    content = F.when(key % 13 != 0, F.concat(F.lit("é "), "p_name"))
    return table(spark, sf_dir, "part").select(_repo(), path.alias("path"), content.alias("content"))


_TREE_SQL = f"""tree AS (
  SELECT concat({_FOLDERS}[CAST(p_size % {len(_FOLDERS)} AS INTEGER) + 1], 'f', CAST(p_partkey AS VARCHAR),
                {_NAMES}[CAST(p_partkey % {len(_NAMES)} AS INTEGER) + 1]) AS path,
         CASE WHEN p_partkey % 13 <> 0 THEN concat('é ', p_name) END AS content, p_partkey % {len(_NAMES)} AS kind FROM part)"""


@query("file_inventory", f"""WITH {_TREE_SQL}
SELECT path, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'jsx' WHEN 4 THEN 'tsx' WHEN 5 THEN 'go'
  WHEN 6 THEN 'rust' WHEN 7 THEN 'java' WHEN 8 THEN 'c' WHEN 9 THEN 'c' WHEN 10 THEN 'cpp' WHEN 11 THEN 'cpp' WHEN 12 THEN 'cpp' END AS language,
  CAST(strlen(content) AS BIGINT) AS size, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS service_boundary
FROM tree WHERE content IS NOT NULL AND NOT regexp_matches(path, '(^|/)\\.[^/]*/') AND NOT regexp_matches(path, '(^|/)(venv|__pycache__|node_modules|build|dist)/')""")
def file_inventory(spark, sf_dir):
    return file_source.load_files(_tree(spark, sf_dir)).select("path", "language", "size", "service_boundary")


@query("service_boundaries", f"""WITH {_TREE_SQL}
SELECT split_part(path, '/', 1) AS boundary, count(*) AS files FROM tree
WHERE content IS NOT NULL AND contains(path, '/') AND NOT regexp_matches(path, '(^|/)\\.[^/]*/')
  AND NOT regexp_matches(path, '(^|/)(venv|__pycache__|node_modules|build|dist)/') GROUP BY 1""")
def service_boundaries(spark, sf_dir):
    _, edges = graph.service_boundaries(file_source.load_files(_tree(spark, sf_dir)))
    return edges.groupBy(F.col("dst").alias("boundary")).agg(F.count(F.lit(1)).alias("files"))


_MANIFESTS_SQL = """m AS (
  SELECT concat('repo', CAST(p_size % 20 AS VARCHAR)) AS repo_key,
    CASE WHEN p_partkey % 50 = 7 THEN 'pyproject.toml' WHEN p_partkey % 50 = 8 THEN 'package.json'
         ELSE concat(CASE WHEN p_partkey % 6 = 0 THEN 'venv/' WHEN p_partkey % 6 = 1 THEN 'a/' ELSE '' END,
                     CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END, 'requirements-', lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '.txt') END AS path
  FROM part)"""


@query("manifests", f"""WITH {_MANIFESTS_SQL},
r AS (SELECT DISTINCT repo_key, path FROM m WHERE regexp_matches(path, '(^|/)requirements[^/]*[.]txt$') AND NOT starts_with(path, 'venv/'))
SELECT repo_key, 'requirements' AS kind, path, CAST(rn AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY string_split(path, '/')) AS rn FROM r) WHERE rn <= 10
UNION ALL SELECT DISTINCT repo_key, CASE WHEN path = 'pyproject.toml' THEN 'pyproject' ELSE 'package_json' END, path, CAST(1 AS BIGINT)
FROM m WHERE path IN ('pyproject.toml', 'package.json')""")
def manifests(spark, sf_dir):
    k = F.col("p_partkey")
    path = (
        F.when(k % 50 == 7, "pyproject.toml")
        .when(k % 50 == 8, "package.json")
        .otherwise(
            F.concat(
                F.when(k % 6 == 0, "venv/").when(k % 6 == 1, "a/").otherwise(""),
                F.when(k % 4 == 0, "x").otherwise(""),
                F.lit("requirements-"), F.lpad(k.cast("string"), 9, "0"), F.lit(".txt"),
            )
        )
    )
    corpus = table(spark, sf_dir, "part").select(
        F.concat(F.lit("repo"), (F.col("p_size") % 20).cast("string")).alias("repo_key"), path.alias("path")
    )
    found = file_source.find_manifests(corpus)
    return found.withColumn("position", F.col("position").cast("bigint"))


# ------------------------------------------------------------------- reports
# One report per lineitem row: documents stay small however rows are spread.

def _documents(spark, sf_dir, document: Column, *more: Column):
    return table(spark, sf_dir, "lineitem").select(_repo(), *more, F.to_json(document).alias("document"))


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


_COMMON = ("issue_class", "severity", "title", "description", "file_path", "tool_source", "rule_id")


@query("bandit_findings", f"""WITH l AS (SELECT *, {sql.path('l_partkey')} AS f FROM lineitem)
SELECT 'security_vulnerability' AS issue_class, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'low' ELSE 'medium' END AS severity,
  concat('Bandit: ', CASE WHEN l_suppkey % 9 = 0 THEN 'Issue' ELSE concat('t', CAST(l_suppkey AS VARCHAR)) END) AS title,
  concat('order ', CAST(l_orderkey AS VARCHAR)) AS description, f AS file_path, 'bandit' AS tool_source,
  concat('B', CAST(l_linenumber AS VARCHAR)) AS rule_id, CAST(l_linenumber AS BIGINT) AS line FROM l
UNION ALL SELECT 'functional_bug', 'high', concat('Bandit could not parse file: ', left(concat(repeat('bad ', 25), CAST(l_suppkey AS VARCHAR)), 80)),
  concat('`', f, '` could not be analyzed (', repeat('bad ', 25), CAST(l_suppkey AS VARCHAR), ') — usually a Python syntax error.'), f, 'bandit', 'B000-parse-error', NULL
FROM l WHERE l_linenumber = 7""")
def bandit_findings(spark, sf_dir):
    reason = F.concat(F.repeat(F.lit("bad "), 25), F.col("l_suppkey").cast("string"))
    errors = F.when(
        F.col("l_linenumber") == 7,
        F.array(
            F.struct(_file().alias("filename"), reason.alias("reason")),
            F.struct(F.lit("").alias("filename"), reason.alias("reason")),
        ),
    )
    result = F.struct(
        F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "R", "LOW").otherwise("ODD").alias("issue_severity"),
        F.when(F.col("l_suppkey") % 9 != 0, _text("t", "l_suppkey")).alias("test_name"),
        _text("order ", "l_orderkey").alias("issue_text"),
        _file().alias("filename"),
        F.col("l_linenumber").alias("line_number"),
        F.lit("x = 1").alias("code"),
        _text("B", "l_linenumber").alias("test_id"),
    )
    documents = _documents(spark, sf_dir, F.struct(errors.alias("errors"), F.array(result).alias("results")))
    return reports.read_bandit_report(documents).select(*_COMMON, F.col("line_number").cast("bigint").alias("line"))


@query("eslint_findings", f"""SELECT 'functional_bug' AS issue_class, 'medium' AS severity, concat('ESLint: ', coalesce(r, 'error')) AS title,
  concat('message ', CAST(l_orderkey AS VARCHAR)) AS description, {sql.path('l_partkey')} AS file_path, 'eslint' AS tool_source, r AS rule_id,
  CAST(l_linenumber AS BIGINT) AS line, CAST(l_suppkey AS BIGINT) AS "column"
FROM (SELECT *, CASE WHEN l_suppkey % 4 <> 0 THEN concat('no-', l_returnflag) END AS r FROM lineitem), (VALUES (0), (1), (2)) v(extra)
WHERE l_linenumber % 3 + extra >= 2""")
def eslint_findings(spark, sf_dir):
    messages = F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda extra: F.struct(
            (F.col("l_linenumber") % 3 + extra).alias("severity"),
            F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("no-"), "l_returnflag")).alias("ruleId"),
            _text("message ", "l_orderkey").alias("message"),
            F.col("l_linenumber").alias("line"),
            F.col("l_suppkey").alias("column"),
        ),
    )
    documents = _documents(spark, sf_dir, F.array(F.struct(_file().alias("filePath"), messages.alias("messages"))))
    return reports.read_eslint_report(documents).select(
        *_COMMON, F.col("line_number").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("column")
    )


@query("pip_audit_findings", """SELECT 'security_vulnerability' AS issue_class, 'high' AS severity,
  concat('CVE in part', CAST(l_partkey AS VARCHAR), ': ', coalesce(i, 'CVE-?')) AS title,
  CASE WHEN l_returnflag = 'A' THEN 'Known vulnerability in dependency' ELSE l_returnflag END AS description,
  concat('requirements-', CAST(l_linenumber AS VARCHAR), '.txt') AS file_path, 'pip-audit' AS tool_source, i AS rule_id
FROM (SELECT *, CASE WHEN l_suppkey % 8 <> 0 THEN concat('CVE-', CAST(l_orderkey AS VARCHAR)) END AS i FROM lineitem)""")
def pip_audit_findings(spark, sf_dir):
    vulnerability = F.struct(
        F.when(F.col("l_suppkey") % 8 != 0, _text("CVE-", "l_orderkey")).alias("id"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("description"),
    )
    none = F.filter(F.array(vulnerability), lambda v: F.lit(False))
    dependencies = F.array(
        F.struct(_text("part", "l_partkey").alias("name"), F.array(vulnerability).alias("vulns")),
        F.struct(F.lit("clean").alias("name"), none.alias("vulns")),
    )
    path = F.concat(F.lit("requirements-"), F.col("l_linenumber").cast("string"), F.lit(".txt")).alias("path")
    documents = _documents(spark, sf_dir, F.struct(dependencies.alias("dependencies")), path)
    return reports.read_pip_audit_report(documents).select(*_COMMON)


@query("npm_audit_findings", """SELECT 'security_vulnerability' AS issue_class,
  CASE l_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END AS severity,
  concat('npm: m', CAST(l_partkey AS VARCHAR), ' - ', l_linestatus) AS title, '' AS description, 'package.json' AS file_path,
  'npm-audit' AS tool_source, CAST(l_orderkey * 10 + e AS VARCHAR) AS rule_id FROM lineitem, (VALUES (0), (1)) v(e)""")
def npm_audit_findings(spark, sf_dir):
    levels = F.array(*[F.lit(s) for s in ("critical", "high", "moderate", "low", "strange")])
    record = F.struct(
        F.get(levels, (F.col("l_suppkey") % 5).cast("int")).alias("severity"),
        _text("m", "l_partkey").alias("module_name"),
        F.col("l_linestatus").alias("title"),
    )
    key = F.col("l_orderkey") * 10
    advisories = F.create_map(key.cast("string"), record, (key + 1).cast("string"), record)
    documents = _documents(spark, sf_dir, F.struct(advisories.alias("advisories")))
    return reports.read_npm_audit_report(documents).select(*_COMMON)


@query("safety_findings", """SELECT 'security_vulnerability' AS issue_class, 'high' AS severity,
  concat('Safety: ', CASE WHEN l_suppkey % 7 = 0 THEN 'unknown' ELSE concat('p', CAST(l_partkey AS VARCHAR)) END, ' vulnerability') AS title,
  concat('<', CAST(l_orderkey AS VARCHAR)) AS description, 'requirements.txt' AS file_path, 'safety' AS tool_source, CAST(NULL AS VARCHAR) AS rule_id FROM lineitem""")
def safety_findings(spark, sf_dir):
    items = F.array(
        F.struct(
            F.when(F.col("l_suppkey") % 7 != 0, _text("p", "l_partkey")).alias("package_name"),
            _text("<", "l_orderkey").alias("vulnerability_spec"),
        )
    )
    wrapped = F.to_json(F.struct(items.alias("vulnerabilities")))
    document = F.when(F.col("l_orderkey") % 2 == 0, F.to_json(items)).otherwise(wrapped)
    documents = table(spark, sf_dir, "lineitem").select(_repo(), document.alias("document"))
    return reports.read_safety_report(documents).select(*_COMMON)


def compiler_logs(spark, sf_dir):
    """A compiler run per part, with errors of its own file, of others and of missing headers."""
    key = F.col("p_partkey").cast("string")

    def line(i: Column) -> Column:
        name = F.when(i % 4 == 0, F.lit("/usr/include/other.h")).otherwise(F.concat(F.lit("/tmp/x/src/p"), key, F.lit(".c")))
        column = F.when(i % 2 == 0, F.concat(i.cast("string"), F.lit(":"))).otherwise("")
        label = F.when(i % 3 == 0, " fatal error: ").otherwise(" error: ")
        message = F.when(i % 5 == 0, F.lit("z.h: No such file or directory")).otherwise(
            F.concat(F.lit("expected '"), i.cast("string"), F.lit("'"))
        )
        return F.concat(name, F.lit(":"), (i * 3).cast("string"), F.lit(":"), column, label, message, F.lit("\n   note: here\n"))

    numbers = F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: i <= F.col("p_size") % 10)
    return table(spark, sf_dir, "part").select(
        _repo(), F.concat(F.lit("src/p"), key, F.lit(".c")).alias("path"), F.array_join(F.transform(numbers, line), "").alias("log")
    )


@query("compiler_findings", """WITH e AS (
  SELECT p_partkey, i, CASE WHEN i % 2 = 0 THEN i END AS col FROM part, generate_series(1, 9) g(i) WHERE i <= p_size % 10 AND i % 4 <> 0 AND i % 5 <> 0)
SELECT concat('src/p', p_partkey, '.c') AS file_path, CAST(i * 3 AS BIGINT) AS line_number, concat('C/C++ syntax error: expected ''', i, '''') AS title,
  concat('`src/p', p_partkey, '.c` fails to compile (line ', i * 3, '): expected ''', i, '''') AS description, 'repo_mapper:compiler' AS tool_source
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM e) WHERE rn <= 3""")
def compiler_findings(spark, sf_dir):
    found = reports.read_compiler_log(compiler_logs(spark, sf_dir))
    return found.select("file_path", F.col("line_number").cast("bigint").alias("line_number"), "title", "description", "tool_source")


def model_replies(spark, sf_dir):
    """One reply per event: bare, fenced or inside prose; some without JSON."""
    event = F.col("event_id")
    classes = {"error": "Bug", "click": "security", "view": "performance", "purchase": "quality", "signup": "other"}
    issue_class = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[F.col("event_type")]
    item = F.to_json(
        F.struct(
            issue_class.alias("class"),
            F.when(event % 4 == 0, "HIGH").when(event % 4 == 1, "odd").alias("severity"),
            F.when(event % 6 == 0, F.lit("x")).otherwise(F.get_json_object("props", "$.k")).alias("line"),
            F.when(event % 8 != 0, F.concat(F.lit("  T "), event.cast("string"), F.lit(" "))).alias("title"),
            F.lit("because").alias("why"),
            F.when(event % 2 == 0, F.lit("  ")).otherwise(F.lit(" root ")).alias("root_cause"),
        )
    )
    listed = F.concat(F.lit("["), item, F.lit(", 7]"))
    keyed = F.concat(F.lit('{"note": 1, "findings": '), listed, F.lit("}"))
    body = F.when(event % 5 == 0, keyed).otherwise(listed)
    reply = (
        F.when(event % 11 == 0, F.lit("nothing [found} here"))
        .when(event % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(event % 3 == 1, F.concat(F.lit("I looked. "), listed, F.lit(" That is all.")))
        .otherwise(body)
    )
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    return table(spark, sf_dir, "events").select(
        _repo(),
        F.concat(F.lit("e/"), (F.col("user_id") % 100).cast("string"), F.lit(".py")).alias("path"),
        content.alias("content"),
        reply.alias("reply"),
        event.alias("seq"),
    )


_MODEL_SQL = """SELECT concat('e/', CAST(user_id % 100 AS VARCHAR), '.py') AS file_path,
  CASE event_type WHEN 'error' THEN 'functional_bug' WHEN 'click' THEN 'security_vulnerability' WHEN 'view' THEN 'performance' ELSE 'code_quality' END AS issue_class,
  CASE WHEN event_id % 4 = 0 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN event_id % 8 <> 0 THEN concat('T ', CAST(event_id AS VARCHAR)) ELSE 'Issue' END AS title, 'because' AS description,
  CASE WHEN event_id % 6 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS line_number,
  CASE WHEN event_id % 2 = 1 THEN 'root' END AS root_cause, CAST(0.8 AS DOUBLE) AS confidence, 'llm' AS tool_source, event_id AS seq
FROM events WHERE event_type <> 'signup' AND event_id % 11 <> 0"""


@query("model_findings", f"""SELECT *, CASE WHEN line_number BETWEEN 1 AND 20 THEN
  array_to_string([concat('line ', CAST(i AS VARCHAR)) FOR i IN generate_series(greatest(line_number - 3, 1), least(line_number + 3, 20))], chr(10)) ELSE '' END AS code_snippet
FROM ({_MODEL_SQL})""")
def model_findings(spark, sf_dir):
    items, _ = reports.read_model_findings(model_replies(spark, sf_dir))
    return map_model_findings(items).select(
        "file_path", "issue_class", "severity", "title", "description",
        F.col("line_number").cast("bigint").alias("line_number"), "root_cause", "confidence", "tool_source", "seq", "code_snippet",
    )


@query("model_reply_rejects", "SELECT event_id AS seq, 'nothing [found} here' AS reply FROM events WHERE event_id % 11 = 0")
def model_reply_rejects(spark, sf_dir):
    _, rejects = reports.read_model_findings(model_replies(spark, sf_dir))
    return rejects.select("seq", "reply")


# -------------------------------------------------------------------- tables

@query("stored_graph", f"WITH {sql.FILE_DEPS} SELECT consumer AS src, dependency AS dst, evidence AS edge_type FROM deps")
def stored_graph(spark, sf_dir):
    folder = f"{checkpoint_folder(spark)}/graph-{uuid.uuid4().hex}"
    deps = views.file_deps(spark, sf_dir)
    edges = deps.select(
        "repo_key", F.col("consumer").alias("src"), F.col("dependency").alias("dst"), F.col("evidence").alias("edge_type"),
        F.lit(True).alias("resolved"), F.lit(None).cast("string").alias("confidence"), F.lit(4).alias("pass_no"),
        F.col("consumer").alias("src_file"), F.col("dependency").alias("dst_file"), F.lit("File").alias("dst_type"),
    )
    names = views.file_names(spark, sf_dir)
    nodes = names.select(
        "repo_key", F.col("path").alias("node_id"), F.lit("File").alias("node_type"), F.col("path").alias("file"),
        F.create_map(F.lit("language"), F.col("language")).alias("attrs"),
    )
    tables.write_graph(nodes, edges, folder)
    stored_nodes, stored_edges = tables.read_graph(spark, folder)
    known = stored_nodes.select("repo_key", F.col("node_id").alias("src"))
    return stored_edges.join(known, ["repo_key", "src"], "left_semi").select("src", "dst", "edge_type")
