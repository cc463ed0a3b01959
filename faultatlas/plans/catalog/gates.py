"""Queries over validation, scoring and publication (H, I, J)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultatlas.operators import approval, gates, publication, python_source
from faultatlas.operators.findings import split_fixable
from faultatlas.plans.catalog import sql, views
from faultatlas.plans.catalog.findings import blast_of_findings, deduped
from faultatlas.plans.catalog.graph import _ANALYSIS
from faultatlas.plans.catalog.registry import query, table
from faultatlas.plans.catalog.sources import compiler_logs
from faultatlas.plans.layout import checkpoint_folder, cut
from faultatlas.sources import tables

# Patterns of the functions that a change has to be approved for.
CRITICAL_FUNCTIONS = [r"\.step$"]

_FIXABLE = f"""{sql.RAW_FINDINGS},
fixable AS (SELECT * FROM findings WHERE issue_class <> 'code_quality' AND severity_rank >= 1)"""


# ------------------------------------------------------------ test discovery

@query("repositories_with_tests", """SELECT concat('r', p_partkey) AS repo_key, p_partkey % 6 IN (0, 1, 2, 3) AS has_tests FROM part""")
def repositories_with_tests(spark, sf_dir):
    key = F.col("p_partkey") % 6
    path = (
        F.when(key == 0, "setup.cfg").when(key == 1, "a/test_x.py").when(key == 2, "tests/data.txt")
        .when(key == 3, "b/x_test.py").when(key == 4, "setup.cfg").otherwise("src/tests.py")
    )
    content = F.when(key == 0, "[tool:PyTest]").otherwise("x = 1")
    files = table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("repo_key"), path.alias("path"), content.alias("content")
    )
    return gates.has_tests(files)


def changed(spark, sf_dir):
    """One patch per order; it changes the files of its lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit(views.REPO).alias("repo_key"),
        F.col("l_orderkey").cast("string").alias("patch_id"),
        views.path_of(F.col("l_partkey")).alias("path"),
    ).distinct()


def _test_files(spark, sf_dir):
    """A test file for every fourth part, some of them in a vendored folder."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("test_"), views.stem_of(key), F.lit(".py"))
    folder = F.when(key % 8 == 0, "lib/site-packages/").otherwise("tests/unit/")
    return table(spark, sf_dir, "part").where(key % 4 == 0).select(
        F.lit(views.REPO).alias("repo_key"), F.concat(folder, name).alias("path")
    )


_CHANGED_SQL = f"""changed AS (SELECT DISTINCT l_orderkey, l_partkey AS k, {sql.path('l_partkey')} AS path FROM lineitem),
matched AS (SELECT CAST(l_orderkey AS VARCHAR) AS patch_id, path AS source, concat('tests/unit/test_', {sql.stem('k')}, '.py') AS test_file
  FROM changed WHERE k % 10 <> 0 AND k % 8 = 4)"""


@query("matched_tests", f"WITH {_CHANGED_SQL} SELECT patch_id, source, test_file FROM matched")
def matched_tests(spark, sf_dir):
    return gates.match_test_files(changed(spark, sf_dir), _test_files(spark, sf_dir)).drop("repo_key")


@query("test_targets", f"""WITH {_CHANGED_SQL}, f AS (SELECT patch_id, string_agg(DISTINCT test_file, ' ' ORDER BY test_file) AS files FROM matched GROUP BY patch_id),
s AS (SELECT CAST(l_orderkey AS VARCHAR) AS patch_id, string_agg(DISTINCT {sql.stem('k')}, ' or ' ORDER BY {sql.stem('k')}) AS names FROM changed GROUP BY l_orderkey)
SELECT s.patch_id, CAST(0 AS INTEGER) AS batch, CASE WHEN files IS NOT NULL THEN 'files' ELSE 'expression' END AS kind, coalesce(files, names) AS target FROM s LEFT JOIN f ON f.patch_id = s.patch_id""")
def test_targets(spark, sf_dir):
    patches = cut(changed(spark, sf_dir))
    return gates.test_targets(patches, gates.match_test_files(patches, _test_files(spark, sf_dir)))


@query("syntax_gates", f"""SELECT CAST(p_partkey AS VARCHAR) AS patch_id, p_partkey % 97 <> 5 AND p_partkey % 31 <> 0 AS gate_1_ast_valid FROM part""")
def syntax_gates(spark, sf_dir):
    """One patch per source file; some patched files are missing."""
    key = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(key.cast("string").alias("patch_id"), views.path_of(key).alias("path"), key.alias("k"))
    patched = (
        views.code_corpus(spark, sf_dir).join(names.where(F.col("k") % 31 != 0), "path").select("patch_id", "path", "content")
    )
    return gates.gate_syntax(names, patched)


@query("compiled_gates", """SELECT CAST(p_partkey AS VARCHAR) AS patch_id, p_partkey % 31 <> 0
    AND NOT EXISTS (SELECT 1 FROM generate_series(1, 9) g(i) WHERE i <= p_size % 10 AND i % 4 <> 0 AND i % 5 <> 0) AS gate_1_ast_valid FROM part""")
def compiled_gates(spark, sf_dir):
    """One patch per C file, with its compiler run; some patched files are missing."""
    logs = compiler_logs(spark, sf_dir).select(F.regexp_extract("path", "p([0-9]+)[.]c$", 1).alias("patch_id"), "path", "log")
    patched = logs.where(F.col("patch_id").cast("long") % 31 != 0).select("patch_id", "path", F.lit("int x;\n").alias("content"))
    return gates.gate_syntax(logs, patched, logs)


@query("regression_targets", f"""WITH {sql.impact(2, "changed")},
near AS (SELECT file AS patch_id, file AS path FROM changed UNION SELECT root, node FROM members WHERE NOT is_test),
tests AS (SELECT DISTINCT n.patch_id, concat('tests/unit/test_', {sql.stem('k')}, '.py') AS test_file FROM near n JOIN files f ON f.path = n.path WHERE k % 10 <> 0 AND k % 8 = 4),
parts AS (SELECT patch_id, test_file, CAST((row_number() OVER (PARTITION BY patch_id ORDER BY test_file) - 1) // 50 AS INTEGER) AS batch FROM tests),
listed AS (SELECT patch_id, batch, string_agg(test_file, ' ' ORDER BY test_file) AS target FROM parts GROUP BY patch_id, batch)
SELECT c.file AS patch_id, coalesce(batch, 0) AS batch, CASE WHEN target IS NULL THEN 'none' ELSE 'files' END AS kind, target
FROM changed c LEFT JOIN listed l ON l.patch_id = c.file""")
def regression_targets(spark, sf_dir):
    """The tests near the change of every file asked about, fifty to a batch."""
    asked = views.changed_files(spark, sf_dir).select("repo_key", F.col("file").alias("patch_id"), F.col("file").alias("path"))
    return gates.regression_targets(asked, cut(views.file_deps(spark, sf_dir)), _test_files(spark, sf_dir), batch_size=50)


# -------------------------------------------------------------------- gates

def attempts(spark, sf_dir):
    """One attempt of each order per line number."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("supp")
    )
    return rows.select(
        key.cast("string").alias("patch_id"),
        (number - 1).alias("attempt"),
        "supp",
        ((key + number) % 5 != 0).alias("gate_1_ast_valid"),
        (key % 11 != 0).alias("has_tests"),
        (key % 9 != 0).alias("runner_available"),
        (key % 13 != 0).alias("scanner_available"),
        F.when(key % 4 != 0, F.concat(F.lit("bandit:B"), (key % 7).cast("string"))).alias("rule_id"),
    )


def runs(spark, sf_dir):
    state = F.col("supp") % 4
    one = attempts(spark, sf_dir).select("patch_id", "attempt", state.alias("state"), F.col("supp"))
    targeted = one.select(
        "patch_id", "attempt", F.lit("targeted").alias("scope"),
        F.get(F.array(F.lit(0), F.lit(1), F.lit(5), F.lit(None).cast("int")), F.col("state").cast("int")).alias("exit_code"),
        (F.col("state") == 3).alias("timed_out"),
    )
    full = one.select(
        "patch_id", "attempt", F.lit("full").alias("scope"), F.when(F.col("supp") % 6 == 0, 1).otherwise(0).alias("exit_code"),
        F.lit(False).alias("timed_out"),
    )
    return targeted.unionByName(full)


def scans(spark, sf_dir):
    """Scanner rows of three attempts: returned lines are before, the others after."""
    supp = F.col("l_suppkey")
    levels = F.array(*[F.lit(s) for s in ("LOW", "MEDIUM", "HIGH")])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("patch_id"),
        (F.col("l_partkey") % 3).cast("int").alias("attempt"),
        F.when(F.col("l_returnflag") == "A", "before").otherwise("after").alias("phase"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("bandit:B"), (supp % 7).cast("string")).alias("check_id"),
        F.concat(F.lit("m"), (supp % 3).cast("string")).alias("message"),
        F.get(levels, (supp % 3).cast("int")).alias("severity"),
        F.col("l_linenumber").alias("line"),
    )


_GATES_SQL = """a AS (
  SELECT l_orderkey AS k, l_linenumber - 1 AS attempt, min(l_suppkey) AS supp, (l_orderkey + l_linenumber) % 5 <> 0 AS g1,
    l_orderkey % 11 <> 0 AS has_tests, l_orderkey % 9 <> 0 AS runner, l_orderkey % 13 <> 0 AS scanner
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
sev AS (SELECT l_orderkey AS k, l_partkey % 3 AS attempt, true AS severe FROM lineitem WHERE l_returnflag <> 'A' AND l_suppkey % 3 = 2 GROUP BY 1, 2),
g2 AS (SELECT a.*, NOT coalesce(severe, false) AS scanner_ok,
    CASE WHEN NOT has_tests THEN true WHEN NOT runner THEN false ELSE supp % 4 IN (0, 2) END AS tests_ok FROM a LEFT JOIN sev USING (k, attempt)),
g3 AS (SELECT *, g1 AND has_tests AND tests_ok AND scanner_ok AS gate2 FROM g2),
g4 AS (SELECT *, CASE WHEN g1 AND has_tests AND gate2 THEN supp % 6 <> 0 ELSE g1 END AS gate3 FROM g3),
g5 AS (SELECT *, CASE WHEN has_tests THEN g1 AND gate2 AND gate3 ELSE g1 AND scanner_ok END AS passed FROM g4),
s AS (SELECT l_orderkey AS k, l_partkey % 3 AS attempt, concat('f', l_partkey % 5, '.py') AS path, concat('bandit:B', l_suppkey % 7) AS check_id, concat('m', l_suppkey % 3) AS message,
    l_returnflag = 'A' AS is_before, l_suppkey % 3 IN (1, 2) AS serious FROM lineitem),
new_rows AS (SELECT k, attempt, path, check_id, message, count(*) AS copies FROM s WHERE NOT is_before
   AND (k, attempt, path, check_id, message) NOT IN (SELECT k, attempt, path, check_id, message FROM s WHERE is_before) GROUP BY 1, 2, 3, 4, 5 HAVING bool_or(serious)),
n AS (SELECT k, attempt, count(*) AS new_count FROM new_rows GROUP BY k, attempt),
sec AS (SELECT a.k, a.attempt, a.scanner,
    a.k % 4 = 0 OR NOT EXISTS (SELECT 1 FROM s WHERE s.k = a.k AND s.attempt = a.attempt AND NOT is_before AND check_id = concat('bandit:B', a.k % 7)) AS original_gone,
    coalesce(new_count, 0) AS new_count FROM a LEFT JOIN n ON n.k = a.k AND n.attempt = a.attempt),
sec2 AS (SELECT *, NOT scanner OR (original_gone AND new_count = 0) AS gate4 FROM sec)"""


def gated(spark, sf_dir):
    tried, ran = cut(attempts(spark, sf_dir)), runs(spark, sf_dir)
    second = gates.gate_tests(tried, ran, scans(spark, sf_dir))
    third = gates.gate_regressions(second, ran)
    return tried, third.withColumn("passed", gates.validation_passed())


@query("gate_results", f"""WITH {_GATES_SQL} SELECT CAST(k AS VARCHAR) AS patch_id, CAST(attempt AS BIGINT) AS attempt, has_tests AS tests_available, gate2 AS gate_2_tests_passed,
  gate3 AS gate_3_no_regressions, g1 AND has_tests AND gate2 AS full_suite_run, passed FROM g5""")
def gate_results(spark, sf_dir):
    _, results = gated(spark, sf_dir)
    return results.select(
        "patch_id", F.col("attempt").cast("bigint").alias("attempt"), "tests_available", "gate_2_tests_passed",
        "gate_3_no_regressions", "full_suite_run", "passed",
    )


@query("focused_gates", f"""WITH {_GATES_SQL},
f1 AS (SELECT *, has_tests AND NOT (g1 AND runner AND supp % 4 = 2) AS available FROM g2),
f2 AS (SELECT *, g1 AND available AND tests_ok AND scanner_ok AS gate_2 FROM f1),
f3 AS (SELECT *, CASE WHEN g1 AND available AND gate_2 THEN supp % 3 = 0 OR supp % 6 <> 2 ELSE g1 END AS gate_3 FROM f2)
SELECT CAST(k AS VARCHAR) AS patch_id, CAST(attempt AS BIGINT) AS attempt, available AS tests_available, gate_2 AS gate_2_tests_passed, gate_3 AS gate_3_no_regressions,
  false AS full_suite_run, CASE WHEN available THEN g1 AND gate_2 AND gate_3 ELSE g1 AND scanner_ok END AS passed FROM f3""")
def focused_gates(spark, sf_dir):
    """The gates with the tests near the change in place of the full suite; some attempts have none."""
    tried = cut(attempts(spark, sf_dir))
    affected = tried.where("supp % 3 <> 0").select(
        "patch_id", "attempt", F.lit("affected").alias("scope"), F.when(F.col("supp") % 6 == 2, 1).otherwise(0).alias("exit_code"), F.lit(False).alias("timed_out")
    )
    ran = runs(spark, sf_dir).unionByName(affected)
    second = gates.gate_tests(tried, ran, scans(spark, sf_dir), run_full_suite=False)
    third = gates.gate_regressions(second, ran, run_full_suite=False).withColumn("passed", gates.validation_passed())
    return third.select(
        "patch_id", F.col("attempt").cast("bigint").alias("attempt"), "tests_available", "gate_2_tests_passed",
        "gate_3_no_regressions", "full_suite_run", "passed",
    )


@query("new_security_findings", f"WITH {_GATES_SQL} SELECT CAST(k AS VARCHAR) AS patch_id, CAST(attempt AS BIGINT) AS attempt, path, check_id, message, copies FROM new_rows")
def new_security_findings(spark, sf_dir):
    return gates.new_security_findings(scans(spark, sf_dir)).withColumn("attempt", F.col("attempt").cast("bigint"))


@query("security_diff", f"""WITH {_GATES_SQL} SELECT CAST(k AS VARCHAR) AS patch_id, CAST(attempt AS BIGINT) AS attempt, original_gone, new_count, gate4 AS gate_4_security_clean FROM sec2""")
def security_diff(spark, sf_dir):
    diff = gates.security_diff(attempts(spark, sf_dir), scans(spark, sf_dir))
    return diff.select("patch_id", F.col("attempt").cast("bigint").alias("attempt"), "original_gone", "new_count", "gate_4_security_clean")


@query("selected_attempts", f"""WITH {_GATES_SQL}, t AS (SELECT g5.k, g5.attempt, g5.supp % 5 <> 0 AND passed AND gate4 AS resolved FROM g5 JOIN sec2 ON sec2.k = g5.k AND sec2.attempt = g5.attempt WHERE g5.attempt < 3)
SELECT CAST(k AS VARCHAR) AS patch_id, CAST(coalesce(min(attempt) FILTER (WHERE resolved), max(attempt)) AS BIGINT) AS attempt, bool_or(resolved) AS resolved FROM t GROUP BY k""")
def selected_attempts(spark, sf_dir):
    tried, results = gated(spark, sf_dir)
    key = ["patch_id", "attempt"]
    diff = gates.security_diff(tried, scans(spark, sf_dir)).select(*key, "gate_4_security_clean")
    joined = results.join(diff, key).join(tried.select(*key, (F.col("supp") % 5 != 0).alias("patch_ok")), key)
    return gates.select_attempt(joined).select("patch_id", F.col("attempt").cast("bigint").alias("attempt"), "resolved")


@query("changed_sets", f"""WITH o AS (SELECT l_orderkey, {sql.path('min(l_partkey)')} AS f, {sql.path('max(l_partkey)')} AS g FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN f = g THEN f ELSE concat(f, '>', g) END AS files FROM o""")
def changed_sets(spark, sf_dir):
    first, last = views.path_of(F.min("l_partkey")), views.path_of(F.max("l_partkey"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first.alias("f"), last.alias("g"))
    return orders.select("l_orderkey", F.array_join(gates.changed_set(F.col("f"), F.array("g", "f")), ">").alias("files"))


# ------------------------------------------------------------------ approval

def validations(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo_key"),
        key.alias("change"),
        (key % 2 == 0).alias("gate_1_ast_valid"),
        (key % 3 != 0).alias("gate_2_tests_passed"),
        (key % 5 != 0).alias("gate_4_security_clean"),
        (key % 11 != 0).alias("tests_available"),
        (key % 7 != 0).alias("test_runner_available"),
        (key % 13 != 0).alias("security_scanner_available"),
        (key % 4 == 0).alias("full_suite_run"),
        (key % 6 == 0).alias("memory_hit"),
        (key % 8 == 0).alias("is_first_item"),
    )


_SCORES_SQL = """points AS (SELECT *, (CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN 40 ELSE 0 END) AS t, (CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 THEN 25 ELSE 0 END) AS s,
    (CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END) AS a, (CASE WHEN o_orderkey % 6 = 0 THEN 15 ELSE 0 END) AS m, (CASE WHEN o_orderkey % 8 = 0 THEN 10 ELSE 0 END) AS f FROM orders),
scores AS (SELECT *, (CASE WHEN o_orderkey % 11 <> 0 THEN t + s + a + m + f ELSE least(t + s + a + m + f, 60) END) / 100.0 AS total_score FROM points)"""


@query("confidence_scores", f"""WITH {_SCORES_SQL} SELECT o_orderkey AS change, CAST(t / 100.0 AS DOUBLE) AS tests_signal, CAST(s / 100.0 AS DOUBLE) AS security_clean_signal, CAST(a / 100.0 AS DOUBLE) AS ast_valid_signal,
  CAST(m / 100.0 AS DOUBLE) AS cache_hit_signal, CAST(f / 100.0 AS DOUBLE) AS fix_order_signal, CAST(total_score AS DOUBLE) AS total_score FROM scores""")
def confidence_scores(spark, sf_dir):
    return approval.confidence(validations(spark, sf_dir)).select(
        "change", "tests_signal", "security_clean_signal", "ast_valid_signal", "cache_hit_signal", "fix_order_signal", "total_score"
    )


@query("approvals", f"""WITH {_SCORES_SQL}, c AS (SELECT *, o_orderstatus = 'P' AS critical FROM scores)
SELECT o_orderkey AS change, CASE WHEN total_score >= 0.95 THEN 'auto_merge_eligible' WHEN total_score < 0.70 THEN 'needs_approval' ELSE 'mergeable' END AS confidence_band,
  total_score < 0.70 OR critical AS requires_approval, NOT (total_score < 0.70 OR critical) AS merge_eligible, total_score >= 0.95 AS auto_merge_eligible FROM c""")
def approvals(spark, sf_dir):
    scored = approval.confidence(validations(spark, sf_dir))
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change"), (F.col("o_orderstatus") == "P").alias("is_critical_path"))
    return approval.approval(scored.join(status, "change")).select(
        "change", "confidence_band", "requires_approval", "merge_eligible", "auto_merge_eligible"
    )


_WORDS = ["src/auth/a.py", "lib/jwtool.js", "Crypto.c", "forgotpassword.html", "x/LOGIN.ts", "user_session.rb", "oauth2.go", "author.txt", "plain.py"]
_FUNCTIONS = ["Authenticate_user", "reauthorize", "rehash", "encrypt", "assign", "load", "run"]


@query("critical_paths", f"""WITH c AS (SELECT p_partkey, {_WORDS}[CAST(p_partkey % {len(_WORDS)} AS INTEGER) + 1] AS path, {_FUNCTIONS}[CAST(p_size % {len(_FUNCTIONS)} AS INTEGER) + 1] AS fn,
  ['info', 'low', 'medium', 'high', 'critical'][CAST(p_partkey % 5 AS INTEGER) + 1] AS severity FROM part),
m AS (SELECT *, regexp_matches(path, '.*auth.*\\.py|.*jwt.*|.*crypto.*|.*password.*|.*login.*|.*session.*|.*oauth.*', 'i') AS file_hit,
  regexp_matches(fn, '.*authenticate.*|.*authorize.*|.*hash.*|.*encrypt.*|.*sign.*', 'i') AS fn_hit, severity IN ('high', 'critical') AS sev FROM c),
r AS (SELECT *, concat_ws(', ', CASE WHEN file_hit THEN 'touches security-related file' END, CASE WHEN fn_hit THEN 'modifies security-critical function' END,
  CASE WHEN sev THEN concat(severity, ' severity finding') END) AS reason FROM m)
SELECT p_partkey, file_hit OR fn_hit OR sev AS is_critical, CASE WHEN reason = '' THEN 'crosses service boundary or modifies auth endpoint' ELSE reason END AS reason FROM r""")
def critical_paths(spark, sf_dir):
    def pick(values, by):
        return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))

    key = F.col("p_partkey")
    path, severity = pick(_WORDS, key), pick(["info", "low", "medium", "high", "critical"], key)
    touches = approval.is_critical_function(pick(_FUNCTIONS, F.col("p_size")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        approval.is_critical_path(path, severity, touches).alias("is_critical"),
        approval.critical_reason(path, severity, touches).alias("reason"),
    )


# --------------------------------------------------------------- publication

def changes(spark, sf_dir):
    """One change per file with fixable findings, scored by its number of findings."""
    findings = cut(split_fixable(deduped(spark, sf_dir))[0])
    blast = blast_of_findings(spark, sf_dir, findings)
    n = F.col("finding_count")
    lists = publication.issue_lists(findings)
    reach = blast.select("repo_key", "file", F.col("file_count").alias("blast_radius"), "module_count")
    second = F.when(n % 3 == 0, F.array(F.col("file"), F.lit("other.py"))).otherwise(F.array("file"))
    joined = lists.join(reach, ["repo_key", "file"]).select(
        "*",
        second.alias("changed_files"),
        F.when(n % 2 == 0, F.repeat(F.lit("+line\n"), 1100)).otherwise(F.lit("")).alias("diff_content"),
        (n % 2 == 0).alias("gate_1_ast_valid"),
        (n % 3 != 0).alias("gate_2_tests_passed"),
        (n % 5 != 0).alias("gate_4_security_clean"),
        (n % 4 != 0).alias("tests_available"),
        F.lit(True).alias("test_runner_available"),
        (n % 7 != 0).alias("security_scanner_available"),
        (n % 6 == 0).alias("memory_hit"),
        F.lit(False).alias("is_first_item"),
    )
    # Functions called ``step`` count as critical here, so that some files have one and others none.
    symbols = python_source.symbols(python_source.parse_python(views.code_files(spark, sf_dir)))
    functions = symbols.select("repo_key", "file", F.col("symbol_id").alias("node_id"), F.col("kind").alias("node_type"))
    touched = approval.critical_functions(functions, CRITICAL_FUNCTIONS).withColumn("_touches", F.lit(True))
    joined = joined.join(touched, ["repo_key", "file"], "left").fillna(False, ["_touches"])
    critical = approval.is_critical_path(F.col("file"), F.col("primary_severity"), F.col("_touches"))
    return approval.approval(approval.confidence(joined).withColumn("is_critical_path", critical).drop("_touches"))


_CHANGES_SQL = f"""{_FIXABLE}, {sql.impact(3)}, {_ANALYSIS},
p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY severity_rank DESC, source_priority, seq) AS best,
   row_number() OVER (PARTITION BY file_path ORDER BY source_priority, seq) AS place, count(*) OVER (PARTITION BY file_path) AS n FROM fixable),
ids AS (SELECT file_path, string_agg(finding_id, ',' ORDER BY place) AS finding_ids,
   string_agg(concat('* ', severity, ': ', title, ' [', issue_class, ']', CASE WHEN line_number > 0 THEN concat(' at line ', line_number) ELSE '' END,
     CASE WHEN root_cause IS NOT NULL THEN concat('; cause: ', root_cause) ELSE '' END), chr(10) ORDER BY place) AS issue_lines FROM p GROUP BY file_path),
c0 AS (SELECT p.file_path AS file, p.finding_id, p.title, p.severity, p.root_cause, n, finding_ids, issue_lines, file_count, module_count,
   (CASE WHEN n % 3 <> 0 THEN 40 ELSE 0 END) AS t, (CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN 25 ELSE 0 END) AS s, (CASE WHEN n % 2 = 0 THEN 10 ELSE 0 END) AS a, (CASE WHEN n % 6 = 0 THEN 15 ELSE 0 END) AS m
   , k % 11 = 0 AND k % 97 <> 5 AS touches
   FROM p JOIN ids ON ids.file_path = p.file_path JOIN analysed ON analysed.file = p.file_path JOIN files ON files.path = p.file_path WHERE best = 1),
c AS (SELECT *, CASE WHEN n % 4 <> 0 THEN t + s + a + m ELSE least(t + s + a + m, 60) END AS points, severity IN ('high', 'critical') OR touches AS critical FROM c0)"""


@query("pr_records", f"""WITH {_CHANGES_SQL}
SELECT file, finding_id, finding_ids, CASE WHEN n = 1 THEN concat('[Fix] ', title) ELSE concat('[Fix] ', file, ': ', n, ' issues (', severity, '+)') END AS title,
  concat('fix/', finding_id, '-20260102-030405') AS branch_name, CASE WHEN n % 3 = 0 THEN concat(file, '>other.py') ELSE file END AS files_changed,
  CAST(points / 100.0 AS DOUBLE) AS total_score, critical AS is_critical_path,
  CASE WHEN file_count = 0 THEN 'Reaches no other file' ELSE concat(CASE WHEN file_count <= 2 THEN 'Narrow' WHEN file_count <= 8 THEN 'Moderate' ELSE 'Wide' END,
    ': reaches ', file_count, ' other files in ', module_count, ' modules', CASE WHEN file_count > 8 THEN '; review every caller' ELSE '' END) END AS blast_radius_summary,
  coalesce(root_cause, '') AS root_cause_explanation, points < 70 OR critical AS requires_approval FROM c""")
def pr_records(spark, sf_dir):
    records = publication.pr_records(changes(spark, sf_dir), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    return records.select(
        "file", "finding_id", F.array_join("finding_ids", ",").alias("finding_ids"), "title", "branch_name",
        F.array_join("files_changed", ">").alias("files_changed"), "total_score", "is_critical_path",
        "blast_radius_summary", "root_cause_explanation", "requires_approval",
    )


@query("pr_bodies", f"""WITH {_CHANGES_SQL}, nl AS (SELECT chr(10) AS x)
SELECT file, md5(concat('# ', file, ': ', n, ' findings fixed', x, x, issue_lines, x, x,
  CASE WHEN n % 3 = 0 THEN concat('Changed together: ', file, ', other.py', x, x) ELSE '' END,
  'Score ', points, ' of 100: ', CASE WHEN points < 70 OR critical THEN 'a person has to approve' ELSE 'may be merged automatically' END,
  CASE WHEN critical THEN ' (critical path)' ELSE '' END, x, x, '| signal | weight | counted |', x, '|---|---|---|', x,
  '| tests | 40 | ', CASE WHEN t > 0 THEN 'yes' WHEN n % 4 = 0 THEN 'no tests' ELSE 'no' END, ' |', x,
  '| security scan | 25 | ', CASE WHEN s > 0 THEN 'yes' WHEN n % 7 = 0 THEN 'no scanner' ELSE 'no' END, ' |', x,
  '| syntax | 10 | ', CASE WHEN a > 0 THEN 'yes' ELSE 'no' END, ' |', x, '| known fix | 15 | ', CASE WHEN m > 0 THEN 'yes' ELSE 'no' END, ' |', x, '| order | 10 | no |',
  CASE WHEN n % 2 = 0 THEN concat(x, x, '```diff', x, left(repeat(concat('+line', x), 1100), 6000), x, '(the diff goes on)', x, '```') ELSE '' END)) AS body FROM c, nl""")
def pr_bodies(spark, sf_dir):
    return publication.pr_body(changes(spark, sf_dir)).select("file", F.md5("body").alias("body"))


@query("stored_pull_requests", f"WITH {_CHANGES_SQL} SELECT file, finding_id, points < 70 OR critical AS requires_approval, '2026-01-02' AS created_on FROM c")
def stored_pull_requests(spark, sf_dir):
    folder = f"{checkpoint_folder(spark)}/pull-requests-{uuid.uuid4().hex}"
    created = F.lit("2026-01-02 03:04:05").cast("timestamp")
    tables.write_pull_requests(publication.pr_records(changes(spark, sf_dir), created), folder)
    return spark.read.parquet(folder).select(
        "file", "finding_id", "requires_approval", F.col("created_on").cast("string").alias("created_on")
    )
