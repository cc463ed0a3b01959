"""H: validation gates over result tables, and the before/after security check.

Running tests and scanners is not part of this library; their results are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.operators.impact import impact_members, impact_paths
from faultatlas.operators.python_source import parse_errors
from faultatlas.plans.layout import cut, numbered_parts, rank_within, top_per
from faultatlas.sources.reports import read_compiler_log

# Files that configure a test runner, and folders of foreign code.
TEST_CONFIG_FILES = ["pytest.ini", "tox.ini", "setup.cfg", "pyproject.toml"]
FOREIGN_DIRECTORIES = ["node_modules", "venv", ".venv", "site-packages"]

# Fixed value: exit code of a test run that collected nothing.
NO_TESTS_COLLECTED = 5


def has_tests(files: DataFrame) -> DataFrame:
    """H1: whether a repository has a test suite, by configuration, names or folder.

    Content is read only behind the filter on the names of configuration files.
    """
    path, name = F.col("path"), text.basename(F.col("path"))
    configured = files.where(path.isin(TEST_CONFIG_FILES)).select(
        "repo_key", F.contains(F.lower("content"), F.lit("pytest")).alias("hit")
    )
    named = files.select(
        "repo_key",
        (name.rlike("^test_.*\\.py$") | name.endswith("_test.py") | path.startswith("tests/")).alias("hit"),
    )
    return (
        named.unionByName(configured)
        .groupBy("repo_key")
        .agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("has_tests"))
    )


def match_test_files(changed: DataFrame, files: DataFrame) -> DataFrame:
    """H2: (patch_id, source, test_file) by name, anywhere but in foreign code.

    Which tests a file has does not depend on the patch: distinct files look theirs up
    once, and a patch meets the files that have any.
    """
    patched = changed.select("repo_key", "patch_id", F.col("path").alias("source")).distinct()
    stem = text.stem(F.col("source"))
    wanted = (
        changed.select("repo_key", F.col("path").alias("source")).distinct()
        .withColumn("_stem", stem)
        .where(~(F.col("_stem").startswith("test_") | F.col("_stem").endswith("_test")) & (F.col("_stem") != ""))
        .select(
            "repo_key", "source",
            F.explode(
                F.array(F.concat(F.lit("test_"), "_stem", F.lit(".py")), F.concat("_stem", F.lit("_test.py")))
            ).alias("_name"),
        )
    )
    foreign = F.exists(F.split("path", "/"), lambda p: p.isin(FOREIGN_DIRECTORIES))
    tests = files.where(~foreign & text.basename(F.col("path")).rlike("^test_.*\\.py$|_test\\.py$")).select(
        "repo_key", F.col("path").alias("test_file"), text.basename(F.col("path")).alias("_name")
    )
    found = wanted.join(tests, ["repo_key", "_name"]).drop("_name")
    return patched.join(found, ["repo_key", "source"]).select("repo_key", "patch_id", "source", "test_file")


def test_targets(changed: DataFrame, matched: DataFrame, batch_size: int = 1000) -> DataFrame:
    """H3: what to run per patch: its test files, or else a name expression.

    One row per (patch, batch) of at most ``batch_size`` files or names; all are in
    one of the batches.  A patch with neither has one row of kind ``none``.
    """
    def batches(names: DataFrame, kind: str, between: str) -> DataFrame:
        ranked = rank_within(names, ["patch_id"], [F.col("name")])
        listed = numbered_parts(ranked, ["patch_id"], "position", {"names": F.col("name")}, batch_size)
        return listed.select(
            "patch_id", F.col("part").alias("batch"), F.lit(kind).alias("kind"), F.array_join("names", between).alias("target")
        )

    tests = matched.select("patch_id", F.col("test_file").alias("name")).distinct()
    stems = changed.select("patch_id", text.stem(F.col("path")).alias("name")).where("name <> ''").distinct()
    by_name = stems.join(tests.select("patch_id").distinct(), "patch_id", "left_anti")
    found = batches(tests, "files", " ").unionByName(batches(by_name, "expression", " or "))
    asked = changed.select("patch_id").distinct()
    return asked.join(found, "patch_id", "left").select(
        "patch_id", F.coalesce("batch", F.lit(0)).alias("batch"), F.coalesce("kind", F.lit("none")).alias("kind"), "target"
    )


def regression_targets(changed: DataFrame, deps: DataFrame, files: DataFrame, hops: int = 2, batch_size: int = 1000) -> DataFrame:
    """H6: the test files to run per patch when the full suite is too expensive.

    Those of the changed files and of all production files that the change reaches
    within ``hops``: ``patch_id, batch, kind, target`` as in ``test_targets``, without
    name expressions.  A patch without such tests has one row of kind ``none``.
    """
    seeds = cut(changed.select("repo_key", "patch_id", text.posix(F.col("path")).alias("path")).distinct())
    reached = impact_members(impact_paths(deps, seeds.select("repo_key", F.col("path").alias("file")), hops))
    affected = reached.where(~F.col("is_test")).select("repo_key", F.col("root").alias("path"), "node")
    near = seeds.join(affected, ["repo_key", "path"]).select("repo_key", "patch_id", F.col("node").alias("path"))
    tests = match_test_files(seeds.unionByName(near).distinct(), files)
    targets = test_targets(seeds, tests, batch_size)
    by_file = F.col("kind") == "files"
    return targets.select(
        "patch_id",
        "batch",
        F.when(by_file, "files").otherwise("none").alias("kind"),
        F.when(by_file, F.col("target")).alias("target"),
    ).where(by_file | (F.col("batch") == 0))


def gate_syntax(changed: DataFrame, patched: DataFrame, compiled: DataFrame | None = None) -> DataFrame:
    """H4: gate 1 per patch: every changed file exists, its Python parses and its C compiles.

    ``changed`` is (patch_id, path), ``patched`` (patch_id, path, content).  ``compiled``
    is (patch_id, path, log), the compiler's words on changed C and C++ files where one
    was run; an error inside the file itself fails it.
    """
    present = patched.select("patch_id", "path").distinct().withColumn("_present", F.lit(True))
    sources = patched.where(F.col("path").endswith(".py")).select(
        F.col("patch_id").alias("repo_key"), "path", F.lit("python").alias("language"), "content"
    )
    broken = parse_errors(sources).select(F.col("repo_key").alias("patch_id"), F.col("file").alias("path"))
    if compiled is not None:
        found = read_compiler_log(compiled.select(F.col("patch_id").alias("repo_key"), "path", "log"), per_file=1)
        broken = broken.unionByName(found.select(F.col("repo_key").alias("patch_id"), F.col("file_path").alias("path")))
    broken = broken.distinct().withColumn("_broken", F.lit(True))
    joined = (
        changed.select("patch_id", "path").distinct()
        .join(present, ["patch_id", "path"], "left")
        .join(broken, ["patch_id", "path"], "left")
    )
    fine = F.coalesce(F.col("_present"), F.lit(False)) & ~F.coalesce(F.col("_broken"), F.lit(False))
    return joined.groupBy("patch_id").agg(F.bool_and(fine).alias("gate_1_ast_valid"))


def _passed(exit_code: Column, timed_out: Column) -> Column:
    return ~timed_out & exit_code.isin(0, NO_TESTS_COLLECTED)


def gate_tests(attempts: DataFrame, runs: DataFrame, scans: DataFrame, run_full_suite: bool = True) -> DataFrame:
    """H5: gate 2 per attempt.

    ``attempts`` has (patch_id, attempt, gate_1_ast_valid, has_tests,
    runner_available); ``runs`` the targeted test runs; ``scans`` scanner results
    after the patch.  A run that collected nothing passes, and means the patch has
    no tests only when the full suite is off.
    """
    key = ["patch_id", "attempt"]
    targeted = runs.where("scope = 'targeted'").select(*key, "exit_code", "timed_out")
    severe = (
        scans.where("phase = 'after'")
        .groupBy(*key)
        .agg(F.bool_or(F.upper("severity").isin("HIGH", "CRITICAL")).alias("_severe"))
    )
    joined = attempts.join(targeted, key, "left").join(severe, key, "left")
    ran = F.col("exit_code").isNotNull() | F.coalesce("timed_out", F.lit(False))
    none_collected = F.col("gate_1_ast_valid") & F.col("has_tests") & F.col("runner_available") & (
        ~ran | (~F.coalesce("timed_out", F.lit(False)) & (F.col("exit_code") == NO_TESTS_COLLECTED))
    )
    tests_available = F.col("has_tests") if run_full_suite else F.col("has_tests") & ~none_collected
    tests_ok = F.when(~F.col("has_tests"), True).when(~F.col("runner_available"), False).otherwise(
        ~ran | _passed(F.col("exit_code"), F.coalesce("timed_out", F.lit(False)))
    )
    scanner_ok = ~F.coalesce("_severe", F.lit(False))
    return joined.select(
        *key,
        "gate_1_ast_valid",
        tests_available.alias("tests_available"),
        scanner_ok.alias("scanner_ok"),
        (F.col("gate_1_ast_valid") & tests_available & tests_ok & scanner_ok).alias("gate_2_tests_passed"),
    )


def gate_regressions(gated: DataFrame, runs: DataFrame, run_full_suite: bool = True) -> DataFrame:
    """H6: gate 3 per attempt, from the full suite or from the tests near the change.

    It is only asked of attempts with tests that passed gate 2; for the others it
    follows gate 1.  Without a matching test the focused form passes.
    """
    scope = "full" if run_full_suite else "affected"
    suite = runs.where(F.col("scope") == scope).select(
        "patch_id", "attempt", _passed(F.col("exit_code"), F.col("timed_out")).alias("_suite")
    )
    joined = gated.join(suite, ["patch_id", "attempt"], "left")
    asked = F.col("gate_1_ast_valid") & F.col("tests_available") & F.col("gate_2_tests_passed")
    return joined.withColumn(
        "gate_3_no_regressions",
        F.when(asked, F.coalesce("_suite", F.lit(not run_full_suite))).otherwise(F.col("gate_1_ast_valid")),
    ).withColumn("full_suite_run", asked & F.lit(run_full_suite)).drop("_suite")


def validation_passed() -> Column:
    """H7: gates 1 to 3 with tests; gate 1 and a clean scanner without."""
    return F.when(
        F.col("tests_available"),
        F.col("gate_1_ast_valid") & F.col("gate_2_tests_passed") & F.col("gate_3_no_regressions"),
    ).otherwise(F.col("gate_1_ast_valid") & F.col("scanner_ok"))


def new_security_findings(scans: DataFrame, count_aware: bool = False) -> DataFrame:
    """H8: medium and worse results after a patch that were not there before.

    A result is its path, rule and message.  One aggregation holds both sides, so
    nothing is joined; ``count_aware`` also reports extra copies.
    """
    after = F.col("phase") == "after"
    grouped = scans.groupBy("patch_id", "attempt", "path", "check_id", "message").agg(
        F.count_if(~after).alias("before"),
        F.count_if(after).alias("after"),
        F.bool_or(after & F.lower("severity").isin("medium", "high", "critical")).alias("serious"),
    )
    fresh = F.col("after") > (F.col("before") if count_aware else F.lit(0))
    if not count_aware:
        fresh = fresh & (F.col("before") == 0)
    return grouped.where(fresh & F.col("serious")).select(
        "patch_id", "attempt", "path", "check_id", "message", (F.col("after") - F.col("before")).alias("copies")
    )


def _bare_rule(rule: Column) -> Column:
    return F.substring_index(rule, ":", -1)


def security_diff(attempts: DataFrame, scans: DataFrame, count_aware: bool = False) -> DataFrame:
    """H8: gate 4 per attempt.

    ``attempts`` has (patch_id, attempt, rule_id, scanner_available).  Clean means
    nothing new and the original rule nowhere in the changed files; a finding
    without rule only asks for nothing new, and without a scanner the gate passes.
    """
    key = ["patch_id", "attempt"]
    fresh = new_security_findings(scans, count_aware).groupBy(*key).agg(F.count(F.lit(1)).alias("new_count"))
    present = (
        scans.where("phase = 'after'")
        .select(*key, _bare_rule(F.col("check_id")).alias("_rule"))
        .distinct()
        .withColumn("_present", F.lit(True))
    )
    joined = (
        attempts.withColumn("_rule", _bare_rule(F.col("rule_id")))
        .join(fresh, key, "left")
        .join(present, [*key, "_rule"], "left")
        .fillna(0, ["new_count"])
    )
    gone = F.coalesce(F.nullif("rule_id", F.lit("")), F.lit("")).eqNullSafe("") | F.col("_present").isNull()
    return joined.select(
        *key,
        gone.alias("original_gone"),
        "new_count",
        (~F.col("scanner_available") | (gone & (F.col("new_count") == 0))).alias("gate_4_security_clean"),
        F.col("scanner_available").alias("security_scanner_available"),
    )


def select_attempt(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """H9: the first attempt that passed everything, else the last, unresolved."""
    good = F.col("patch_ok") & F.col("passed") & F.col("gate_4_security_clean")
    tried = attempts.where(F.col("attempt") < max_attempts).withColumn("resolved", good)
    best = F.when(F.col("resolved"), F.col("attempt")).otherwise(-F.col("attempt"))
    return top_per(tried, ["patch_id"], [F.col("resolved").desc(), best])


def changed_set(finding_file: Column, patch_files: Column) -> Column:
    """The finding's file and the patched files, each once, in order."""
    return F.array_distinct(F.concat(F.array(finding_file), patch_files))
