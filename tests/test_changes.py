"""Memory, patches, gates, scores, records and streams."""

from __future__ import annotations

import datetime as dt
import difflib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultatlas import schemas
from faultatlas.operators import approval, gates, memory, patches, publication, reports
from faultatlas.plans.layout import checkpoint_folder
from faultatlas.sources import tables
from faultatlas.streaming import run_feed

# ------------------------------------------------------------------- memory


def test_fix_id_ignores_spelling_but_not_repository(spark):
    rows = [
        ("Team/Shop", "functional_bug", "src\\A.py", "Off by one"),
        (" team/shop ", "Functional_Bug", "src/a.py", " off by one"),
        ("team/other", "functional_bug", "src/a.py", "off by one"),
        (None, "b", "f", "c"),
        ("", "b", "f", "c"),
        ("global", "b", "f", "c"),
    ]
    df = spark.createDataFrame(rows, "r string, t string, f string, c string")
    ids = [r[0] for r in df.select(memory.fix_id(F.col("r"), F.col("t"), F.col("f"), F.col("c"))).collect()]
    assert ids[0] == ids[1] != ids[2] and len(set(ids[3:])) == 1
    assert all(i.startswith("fix:") and len(i) == 28 for i in ids)


def test_upsert_is_idempotent_and_replaces(spark):
    def rows(*items):
        return spark.createDataFrame(
            [(i, dt.datetime(2026, 1, day), f, note) for i, day, f, note in items],
            "fix_id string, validated_at timestamp, finding_id string, note string",
        )

    old = rows(("a", 1, "f1", "old"), ("b", 1, "f2", "kept"))
    new = rows(("a", 2, "f3", "first"), ("a", 3, "f4", "last"), ("c", 1, "f5", "new"))
    once = memory.upsert_fixes(old, new)
    want = {("a", "last"), ("b", "kept"), ("c", "new")}
    assert {(r.fix_id, r.note) for r in once.collect()} == want
    assert {(r.fix_id, r.note) for r in memory.upsert_fixes(once, new).collect()} == want


def test_similar_fixes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(400):
        repo = "big" if i % 3 else f"r{i % 4}"
        vector = centres[i % 6] + 0.35 * rng.normal(size=12)
        rows.append((repo, f"v{i:03d}", [float(x) for x in vector.astype(np.float32)]))
    rows.append(("big", "zero", [0.0] * 12))
    stored = spark.createDataFrame(rows, "repo_key string, fix_id string, embedding array<float>")
    asked = stored.withColumnRenamed("fix_id", "query_id")
    for threshold, k in ((0.85, 3), (0.5, 10)):
        want = {}
        for repo, query, v in rows:
            a = np.array(v)
            near = []
            for other_repo, other, w in rows:
                b = np.array(w)
                if repo == other_repo and query != other and a.any() and b.any():
                    cosine = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
                    if cosine >= threshold:
                        near.append((-cosine, other))
            want[query] = [other for _, other in sorted(near)[:k]]
        hits = memory.query_similar(stored, asked, k, threshold, tile_rows=16, pivots=8, skip_same_id=True)
        got = {}
        for r in sorted(hits.collect(), key=lambda r: r.position):
            got.setdefault(r.query_id, []).append(r.fix_id)
        assert got == {q: ids for q, ids in want.items() if ids}


def test_embedding_finds_the_same_text(spark):
    texts = spark.createDataFrame(
        [("r", "a", "null pointer in parser"), ("r", "b", "sql injection in login form"), ("r", "c", "slow loop over rows")],
        "repo_key string, fix_id string, text string",
    )
    stored = memory.embed_text(texts, memory.fit_embedder(texts))
    hits = memory.query_similar(stored, stored.withColumnRenamed("fix_id", "query_id"), k=1).collect()
    assert {(r.query_id, r.fix_id) for r in hits} == {("a", "a"), ("b", "b"), ("c", "c")}


def test_vectors_without_direction_match_nothing(spark):
    schema = "repo_key string, fix_id string, embedding array<float>"
    rows = [("r", "zero", [0.0, 0.0]), ("r", "null", None), ("r", "hole", [None, 1.0]), ("r", "a", [1.0, 0.0]), ("r", "b", [0.9, 0.1])]
    stored = spark.createDataFrame(rows, schema)
    asked = stored.withColumnRenamed("fix_id", "query_id")
    hits = memory.query_similar(stored, asked, k=2, threshold=0.9).collect()
    assert {(r.query_id, r.fix_id) for r in hits} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}
    zero = asked.where("query_id = 'zero'")
    assert memory.query_similar(stored, zero).count() == 0 and memory.query_similar(stored.limit(0), asked).count() == 0


# ------------------------------------------------------------------- patches


def block(search, replace):
    return f"<<<<<<< SEARCH\n{search}\n=======\n{replace}\n>>>>>>> REPLACE\n"


def apply(spark, files, reply, default="a.py"):
    context = spark.createDataFrame([("p", f, c) for f, c in files.items()], "patch_id string, file_path string, content string")
    replies = spark.createDataFrame([("p", reply, default)], "patch_id string, reply string, default_path string")
    edits, unknown = patches.match_edit_paths(patches.parse_edits(replies), context.withColumnRenamed("file_path", "path"))
    applied = patches.apply_edits(context, edits)
    result = patches.patch_results(replies, applied, unknown).first()
    return result, {r.file_path: r for r in applied.collect()}


def test_ambiguous_anchor_is_refused(spark):
    result, files = apply(spark, {"a.py": "x = 1\ny = 2\nx = 1\n"}, block("x = 1", "x = 3"))
    assert not result.ok and (result.edits_applied, result.edits_total) == (0, 1)
    assert [(p.code, p.edit, p.figure) for p in files["a.py"].problems] == [("many_places", 1, 2)] and "2 places" in files["a.py"].errors[0]


def test_one_bad_edit_fails_the_patch(spark):
    result, files = apply(spark, {"a.py": "x = 1\ny = 2\n"}, block("x = 1", "x = 3") + block("gone", "z"))
    assert not result.ok and (result.edits_applied, result.edits_total, result.error_count) == (1, 2, 1)
    assert files["a.py"].errors == ["Edit 2 fits no place; no lines like `gone` were found."]


def test_patch_over_two_files_in_reply_order(spark):
    reply = "### FILE: z.py\n" + block("b", "c") + "- FILE: ./A.PY\n" + block("x", "y")
    result, files = apply(spark, {"a.py": "x\n", "z.py": "b\n"}, reply)
    assert result.ok and (result.edits_applied, result.edits_total) == (2, 2)
    assert result.changed_files == ["z.py", "a.py"]
    assert files["z.py"].unified_diff == "--- a/z.py\n+++ b/z.py\n@@ -1 +1 @@\n-b\n+c\n"


def test_marker_behind_a_block_is_no_marker(spark):
    reply = "FILE: a.py\n" + block("x", "y").rstrip("\n") + " FILE: z.py\n" + block("b", "c")
    result, files = apply(spark, {"a.py": "x\nb\n", "z.py": "b\n"}, reply)
    assert result.ok and set(files) == {"a.py"} and files["a.py"].new_content == "y\nc\n"


def test_edits_of_a_file_without_content_fail(spark):
    schema = "patch_id string, file_path string, content string"
    contents = spark.createDataFrame([("p", "null.py", None), ("p", "a.py", "x\n")], schema)
    edits = spark.createDataFrame(
        [("p", f, i, "x", "y") for i, f in enumerate(("null.py", "gone.py", "a.py"))],
        "patch_id string, file_path string, seq int, search string, replace string",
    )
    applied = {r.file_path: r for r in patches.apply_edits(contents, edits).collect()}
    assert applied["a.py"].ok and applied["a.py"].new_content == "y\n"
    for name in ("null.py", "gone.py"):
        assert not applied[name].ok and applied[name].errors and applied[name].new_content is None
    rows = patches.apply_edits(contents, edits)
    asked = spark.createDataFrame([("p",), ("q",)], "patch_id string")
    unknown = spark.createDataFrame([("p", "u.py")], "patch_id string, file_path string")
    errors = {(r.patch_id, r.file_path) for r in patches.patch_errors(asked, rows, unknown).collect()}
    assert errors == {("p", "null.py"), ("p", "gone.py"), ("p", "u.py"), ("q", None)}
    assert [r.file_path for r in patches.patch_files(rows).collect()] == ["a.py"]


def test_test_targets_come_in_batches(spark):
    schema = "patch_id string, source string, test_file string"
    matched = spark.createDataFrame([("p", "a.py", f"t/test_{i:04}.py") for i in range(1500)], schema)
    changed = spark.createDataFrame([("r", "p", "a.py")], "repo_key string, patch_id string, path string")
    rows = gates.test_targets(changed, matched).orderBy("batch").collect()
    assert [(r.batch, r.kind, len(r.target.split(" "))) for r in rows] == [(0, "files", 1000), (1, "files", 500)]


def test_edits_build_on_each_other_and_tolerate_trailing_blanks(spark):
    result, files = apply(spark, {"a.py": "one  \r\ntwo\r\n"}, block("one\ntwo", "three\nfour") + block("three", "five"))
    assert result.ok and files["a.py"].new_content == "five\nfour\n"


def test_unknown_files_empty_search_and_silence(spark):
    result, _ = apply(spark, {"a.py": "x\n"}, "FILE: other/b.py\n" + block("x", "y"))
    assert not result.ok and (result.edits_applied, result.edits_total, result.error_count) == (0, 1, 1)
    result, files = apply(spark, {"a.py": "x\n"}, "<<<<<<< SEARCH\n\n=======\ny\n>>>>>>> REPLACE")
    assert not result.ok and files["a.py"].problems[0].code == "blank_search"
    result, _ = apply(spark, {"a.py": "x\n"}, "sorry")
    assert not result.ok and result.error_count == 1 and result.edits_total == 0


def test_rewrite_guard_starts_above_25_lines(spark):
    for lines, ok in ((25, True), (26, False)):
        # The content has one more piece than lines with a final line break, so none.
        old = "\n".join(f"l{i}" for i in range(lines))
        new = "\n".join(f"k{i}" for i in range(lines))
        result, files = apply(spark, {"a.py": old}, block(old, new))
        assert result.ok is ok
        assert [(p.code, p.figure, p.total) for p in files["a.py"].problems] == ([] if ok else [("rewritten", 26, 26)])
    result, files = apply(spark, {"a.py": "x"}, block("x", " "))
    assert not result.ok and [p.code for p in files["a.py"].problems] == ["nothing_left"]


def test_marker_rules(spark):
    reply = (
        block("a", "b") + "FILE: notapath\n" + block("c", "d") + "> # FILE: x/y\n" + block("e", "FILE: q.py") + block("g", "h")
    )
    replies = spark.createDataFrame([("p", reply, "main.py")], "patch_id string, reply string, default_path string")
    edits = {r.seq: (r.file_path, r.search, r.replace) for r in patches.parse_edits(replies).collect()}
    assert edits == {
        1: ("main.py", "a", "b"),
        2: ("main.py", "c", "d"),
        3: ("x/y", "e", "FILE: q.py"),
        4: ("q.py", "g", "h"),  # a marker inside an earlier block counts
    }


def test_unsafe_paths(spark):
    paths = {"../x": False, "a/../../x": False, "/abs": False, "a/../b": True, "a.py": True, "./a": True, "..a/b": True}
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    safe, unsafe = patches.reject_unsafe_paths(df)
    assert {r.file_path for r in safe.collect()} == {p for p, ok in paths.items() if ok}
    assert {r.file_path for r in unsafe.collect()} == {p for p, ok in paths.items() if not ok}


def test_diff_counts(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(20):
        old = [rng.choice("abcd") for _ in range(12)]
        new = [x for x in old if rng.random() > 0.2] + [rng.choice("xyz")]
        pairs.append(("\n".join(old), "\n".join(new)))
    pairs.append(("a\n", "a\n++b\n"))  # an added line that looks like a header is missed
    df = spark.createDataFrame(pairs, "o string, n string")
    got = [(r.s.additions, r.s.deletions) for r in df.select(patches.diff_stats("o", "n").alias("s")).collect()]
    want = []
    for old, new in pairs:
        diff = list(difflib.unified_diff(old.split("\n"), new.split("\n"), lineterm=""))
        want.append(tuple(sum(l.startswith(s) and not l.startswith(s * 3) for l in diff) for s in "+-"))
    assert got[:-1] == want[:-1] and got[-1] == (0, 0)


# --------------------------------------------------------------------- gates

VALIDATION = (
    "gate_1_ast_valid boolean, gate_2_tests_passed boolean, gate_4_security_clean boolean, tests_available boolean, "
    "test_runner_available boolean, security_scanner_available boolean, memory_hit boolean, is_first_item boolean"
)


def test_scores(spark):
    rows = [
        (True, True, True, True, True, False, False, True),  # no scanner: .40 + .10 + .10
        (True, False, True, False, True, True, True, True),  # no tests: at most .60
        (True, True, True, True, True, True, True, True),
        (False, False, False, True, True, True, False, False),
    ]
    scored = approval.confidence(spark.createDataFrame(rows, VALIDATION)).collect()
    assert [r.total_score for r in scored] == [0.6, 0.6, 1.0, 0.0]
    assert scored[0].security_clean_signal == 0 and scored[1].tests_signal == 0
    df = spark.createDataFrame([(0.69, False), (0.7, False), (0.95, False), (1.0, True)], "total_score double, is_critical_path boolean")
    got = [(r.requires_approval, r.merge_eligible, r.auto_merge_eligible) for r in approval.approval(df).collect()]
    assert got == [(True, False, False), (False, True, False), (False, True, True), (True, False, True)]


def test_security_diff_rules(spark):
    schema = "patch_id string, attempt int, phase string, path string, check_id string, message string, severity string"
    scans = spark.createDataFrame(
        [
            ("p", 0, "before", "a.py", "bandit:B1", "m", "HIGH"),
            ("p", 0, "after", "b.py", "bandit:B1", "m", "LOW"),  # the rule remains elsewhere
            ("q", 0, "before", "a.py", "bandit:B2", "m", "HIGH"),
            ("q", 0, "after", "a.py", "bandit:B2", "m", "HIGH"),
            ("q", 0, "after", "a.py", "bandit:B2", "m", "HIGH"),  # a copy is not new
            ("s", 0, "after", "a.py", "bandit:B3", None, "MEDIUM"),
        ],
        schema,
    )
    tried = spark.createDataFrame(
        [("p", 0, "B1", True), ("q", 0, None, True), ("s", 0, None, True), ("t", 0, "B1", True), ("s2", 0, "B9", False)],
        "patch_id string, attempt int, rule_id string, scanner_available boolean",
    )
    got = {r.patch_id: (r.original_gone, r.new_count, r.gate_4_security_clean) for r in gates.security_diff(tried, scans).collect()}
    assert got == {"p": (False, 0, False), "q": (True, 0, True), "s": (True, 1, False), "t": (True, 0, True), "s2": (True, 0, True)}
    counted = {r.patch_id: r.new_count for r in gates.security_diff(tried, scans, count_aware=True).collect()}
    assert counted["q"] == 1


def test_test_discovery(spark):
    files = spark.createDataFrame(
        [("r", p, "") for p in ("tests/test_a.py", "x/a_test.py", "venv/test_a.py", "b.py", "tests/test_b.txt")],
        "repo_key string, path string, content string",
    )
    changed = spark.createDataFrame([("r", "p", "src/a.py"), ("r", "q", "b.py"), ("r", "q", "c.py"), ("r", "s", "test_a.py")], "repo_key string, patch_id string, path string")
    matched = gates.match_test_files(changed, files)
    assert {r.test_file for r in matched.collect()} == {"tests/test_a.py", "x/a_test.py"}
    targets = {r.patch_id: (r.kind, r.target) for r in gates.test_targets(changed, matched).collect()}
    assert targets == {"p": ("files", "tests/test_a.py x/a_test.py"), "q": ("expression", "b or c"), "s": ("expression", "test_a")}


def test_syntax_gate(spark):
    changed = spark.createDataFrame([("p", "a.py"), ("p", "x.js"), ("q", "b.py"), ("s", "gone.py")], "patch_id string, path string")
    patched = spark.createDataFrame([("p", "a.py", "x = 1"), ("p", "x.js", "((("), ("q", "b.py", "x = (")], "patch_id string, path string, content string")
    got = {r.patch_id: r.gate_1_ast_valid for r in gates.gate_syntax(changed, patched).collect()}
    assert got == {"p": True, "q": False, "s": False}


def test_a_file_that_does_not_compile_fails_its_patch(spark):
    changed = spark.createDataFrame([("p", "a.c"), ("p", "b.h"), ("q", "c.cpp"), ("r", "a.c"), ("s", "d.c")], "patch_id string, path string")
    patched = changed.withColumn("content", F.lit("int x"))
    logs = [("p", "a.c", "/t/a.c:1:2: error: expected ';'\n"), ("q", "c.cpp", "/t/c.cpp:1: warning: unused\n/usr/x.h:3: error: bad\n"),
            ("r", "a.c", "/t/a.c:1: fatal error: q.h: No such file or directory\n"), ("s", "d.c", "")]
    compiled = spark.createDataFrame(logs, "patch_id string, path string, log string")
    got = {r.patch_id: r.gate_1_ast_valid for r in gates.gate_syntax(changed, patched, compiled).collect()}
    assert got == {"p": False, "q": True, "r": True, "s": True}


def test_regression_targets_reach_what_depends_on_the_change(spark):
    deps = spark.createDataFrame(
        [("r", "mid.py", "base.py", "CALLS"), ("r", "top.py", "mid.py", "IMPORTS"), ("r", "far.py", "top.py", "IMPORTS"), ("q", "mid.py", "base.py", "CALLS")],
        "repo_key string, consumer string, dependency string, evidence string",
    )
    files = spark.createDataFrame([("r", f"t/test_{n}.py") for n in ("base", "top", "far")] + [("q", "t/test_mid.py")], "repo_key string, path string")
    changed = spark.createDataFrame([("r", "p1", "base.py"), ("r", "p2", "mid.py"), ("r", "p3", "far.py"), ("r", "p4", "lone.py")], "repo_key string, patch_id string, path string")
    got = {r.patch_id: (r.kind, r.target) for r in gates.regression_targets(changed, deps, files).collect()}
    assert got == {
        "p1": ("files", "t/test_base.py t/test_top.py"), "p2": ("files", "t/test_far.py t/test_top.py"),
        "p3": ("files", "t/test_far.py"), "p4": ("none", None),
    }


def test_attempt_selection(spark):
    rows = [("a", 0, True, False, True), ("a", 1, True, True, True), ("a", 2, True, True, True), ("b", 0, True, True, False), ("b", 1, False, True, True), ("b", 3, True, True, True)]
    df = spark.createDataFrame(rows, "patch_id string, attempt int, patch_ok boolean, passed boolean, gate_4_security_clean boolean")
    assert {(r.patch_id, r.attempt, r.resolved) for r in gates.select_attempt(df).collect()} == {("a", 1, True), ("b", 1, False)}


def test_no_tests_collected(spark):
    tried = spark.createDataFrame([("p", 0, True, True, True)], "patch_id string, attempt int, gate_1_ast_valid boolean, has_tests boolean, runner_available boolean")
    ran = spark.createDataFrame([("p", 0, "targeted", 5, False), ("p", 0, "full", 1, False)], "patch_id string, attempt int, scope string, exit_code int, timed_out boolean")
    scans = spark.createDataFrame([], "patch_id string, attempt int, phase string, severity string")
    for full, available in ((True, True), (False, False)):
        gated = gates.gate_regressions(gates.gate_tests(tried, ran, scans, full), ran, full)
        row = gated.withColumn("passed", gates.validation_passed()).first()
        assert row.tests_available is available and row.gate_2_tests_passed is available
        assert row.gate_3_no_regressions is (not full) and row.passed is (not full)


def test_blast_summary_thresholds(spark):
    df = spark.createDataFrame([(n,) for n in (0, 2, 3, 8, 9)], "n int")
    got = [r[0].split(":")[0] for r in df.select(publication.blast_summary(F.col("n"), F.lit(1))).collect()]
    assert got == ["Reaches no other file", "Narrow", "Moderate", "Moderate", "Wide"]


# ------------------------------------------------------------ reports, streams


def test_validation_health_warns_when_nothing_can_tell(spark):
    rows = [("r", True, False, False, False, True, False), ("r", True, True, False, False, True, False), ("s", False, True, True, True, False, True)]
    df = spark.createDataFrame(
        rows, "repo_key string, gate_1_ast_valid boolean, gate_2_tests_passed boolean, gate_4_security_clean boolean, "
        "tests_available boolean, security_scanner_available boolean, full_suite_run boolean",
    )
    got = {r.repo_key: (r.syntax, r.targeted_tests, r.full_suite, r.security) for r in reports.validation_health(df).collect()}
    assert got == {"r": ("pass", "warn", "warn", "fail"), "s": ("fail", "pass", "pass", "warn")}


def test_versions_and_graph_round_trip(spark):
    folder = f"{checkpoint_folder(spark)}/tables-{random.getrandbits(60):x}"
    assert tables.read_versioned(spark, folder, "a int").count() == 0
    for version in (1, 2, 10):
        tables.write_versioned(spark.createDataFrame([(version,)], "a int"), folder, version)
    assert tables.read_versioned(spark, folder, "a int").first().a == 10
    nodes = spark.createDataFrame([("a/b", "n", "File", "n", {"x": "1"}), ("c", "m", "File", "m", {})], schemas.NODES)
    edges = spark.createDataFrame([("c", "m", "k", "CALLS", True, "high", 5, "m", "k", "Function")], schemas.EDGES)
    tables.write_graph(nodes, edges, folder + "/graph")
    read_nodes, read_edges = tables.read_graph(spark, folder + "/graph")
    assert {(r.repo_key, r.node_id) for r in read_nodes.collect()} == {("a/b", "n"), ("c", "m")}
    assert read_edges.where("repo_key = 'c'").first().edge_type == "CALLS"
    own_nodes, own_edges = tables.read_graph(spark, folder + "/graph", "a/b")
    assert [r.node_id for r in own_nodes.collect()] == ["n"] and own_edges.count() == 0


def test_graph_files_follow_the_rows(spark):
    folder = f"{checkpoint_folder(spark)}/sizes-{random.getrandbits(60):x}"

    def written(rows, name):
        # One repository holds a third of the nodes, the others are small.
        nodes = [("hot" if k % 3 == 0 else f"r{k % 50:02d}", f"n{k}", "File", "f", {}) for k in range(rows)]
        edges = spark.createDataFrame([], schemas.EDGES)
        tables.write_graph(spark.createDataFrame(nodes, schemas.NODES), edges, f"{folder}/{name}", rows_per_file=100)
        return nodes, tables.graph_parts(spark, f"{folder}/{name}", "nodes").orderBy("part").collect()

    _, few = written(300, "few")
    nodes, many = written(3000, "many")
    assert len(few) <= 3 and 25 <= len(many) <= 30
    assert sum(p.rows for p in many) == 3000 and max(p.rows for p in many) <= 300
    assert all(a.last_repo <= b.first_repo for a, b in zip(many, many[1:], strict=False))
    assert sum(p.first_repo == p.last_repo == "hot" for p in many) >= 5
    for repo in ("hot", "r07", "none"):
        own, edges = tables.read_graph(spark, f"{folder}/many", repo)
        assert sorted(r.node_id for r in own.collect()) == sorted(n[1] for n in nodes if n[0] == repo)
        assert edges.count() == 0
    assert len(tables.read_graph(spark, f"{folder}/many", "r07")[0].select("node_id", F.input_file_name().alias("f")).select("f").distinct().collect()) <= 3
    plan = tables.read_graph(spark, f"{folder}/many", "r07")[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_streams_over_several_batches(spark):
    folder = f"{checkpoint_folder(spark)}/stream-{random.getrandbits(60):x}"
    start = dt.datetime(2026, 1, 1)
    phases = ["cloning", "phase_4_fix_validate", "phase_5_publication", "phase_4_fix_validate"]
    for i in range(4):
        rows = [(f"j{j}", "pr_created" if i == 3 else "finding_discovered", start + dt.timedelta(seconds=10 * i + j), None, phases[i], f"{i}", {}) for j in range(2)]
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(folder + "/in")

    def events():
        return tables.stream_events(spark, folder + "/in", files_per_trigger=1)

    run_feed.append_batches(run_feed.live_metrics(events()), folder + "/m", mode="update").awaitTermination()
    schema = "job_id string, events bigint, findings bigint, pull_requests bigint, elapsed_seconds bigint"
    metrics = {r.job_id: r for r in run_feed.read_updates(spark, folder + "/m", ["job_id"], schema).collect()}
    assert [(r.events, r.findings, r.pull_requests, r.elapsed_seconds) for r in metrics.values()] == [(4, 3, 1, 30)] * 2

    sliced = run_feed.sliced_metrics(events(), "1 hour", "15 seconds")
    run_feed.append_batches(sliced, folder + "/s", mode="update").awaitTermination()
    schema = "job_id string, slice_start timestamp, events bigint, findings bigint, pull_requests bigint, first_ts timestamp, last_ts timestamp"
    slices = run_feed.read_updates(spark, folder + "/s", ["job_id", "slice_start"], schema)
    assert slices.count() > 2
    folded = run_feed.fold_slices(slices).collect()
    assert [(r.events, r.findings, r.pull_requests, r.elapsed_seconds) for r in folded] == [(4, 3, 1, 30)] * 2

    run_feed.append_batches(run_feed.phase_progress(events()), folder + "/p", mode="update").awaitTermination()
    progress = run_feed.read_updates(spark, folder + "/p", ["job_id"], "job_id string, phase_index int")
    assert {r.phase_index for r in progress.collect()} == {5}

    run_feed.write_latest_feed(events(), folder + "/f", k=3).awaitTermination()
    def shown():
        return sorted((r.job_id, r.message) for r in run_feed.read_latest_feed(spark, folder + "/f", 3).collect())

    before = shown()
    assert before == [(j, m) for j in ("j0", "j1") for m in ("1", "2", "3")]
    run_feed.compact(spark, folder + "/f", schemas.EVENTS, run_feed.read_latest_feed(spark, folder + "/f", 3))
    assert shown() == before


def test_pull_request_records_are_appended(spark):
    folder = f"{checkpoint_folder(spark)}/records-{random.getrandbits(60):x}"
    for day in (1, 2):
        tables.write_pull_requests(spark.createDataFrame([("x", dt.datetime(2026, 1, day))], "pr_id string, created_at timestamp"), folder)
    assert spark.read.parquet(folder).count() == 2


def test_edited_files_leave_the_task_in_small_batches():
    rows = []
    for i in range(350):
        file = {"patch_id": "p", "file_path": f"f{i:03}", "seq": 0, "content": "a\nb\n", "search": None, "replace": None, "is_content": True}
        rows += [file, {**file, "seq": 1, "content": None, "search": "a", "replace": "c", "is_content": False}]
    batches = list(patches._apply_sorted(iter([pa.RecordBatch.from_pylist(rows)])))
    assert max(b.num_rows for b in batches) <= 100
    done = [row for b in batches for row in b.to_pylist()]
    assert [r["file_path"] for r in done] == [f"f{i:03}" for i in range(350)]
    assert {r["new_content"] for r in done} == {"c\nb\n"} and all(r["ok"] for r in done)


def test_text_tasks_ask_for_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 10_000)
    spark.range(1).select(patches.unified_diff(F.lit("a\n"), F.lit("b\n"), F.lit("p"))).collect()
    assert int(spark.conf.get(name)) <= 500
