"""Reports, findings, review and plan tables."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from faultatlas import schemas
from faultatlas.functions import text
from faultatlas.operators import findings as ops
from faultatlas.operators import planning, publication, review
from faultatlas.operators.impact import impact_members, impact_paths
from faultatlas.plans.layout import bounded_list, rank_within, top_per
from faultatlas.sources import files as file_source
from faultatlas.sources import reports

FINDING = "repo_key string, finding_id string, file_path string, line_number int, issue_class string, title string, severity string, source_priority int, seq bigint"


def first_wins(rows):
    """Two seen-sets over the rows in order, the model of dedupe_findings."""
    places, titles, kept = set(), set(), []
    for row in sorted(rows, key=lambda r: (r[7], r[8])):
        place = (row[2], row[3], row[4])
        titled = (*place, row[5].strip().lower())
        if titled in titles or (row[3] is not None and place in places):
            continue
        titles.add(titled)
        places.add(place)
        kept.append(row[1])
    return sorted(kept)


def test_dedupe_equals_two_sets(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [
            ("r", f"id{i}", rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice(["x", "y"]),
             rng.choice([" T", "t ", "u", "\tT\n"]), "low", rng.randrange(3), i)
            for i in range(60)
        ]
        got = ops.dedupe_findings(spark.createDataFrame(rows, FINDING)).collect()
        assert sorted(r.finding_id for r in got) == first_wins(rows)


def test_normalize_paths(spark):
    cases = {
        "/w/repo/a/b.py": "a/b.py",
        "./a.py": "a.py",
        "a\\b.py": "a/b.py",
        "a/./c/../b.py": "a/b.py",
        ".github/x.yml": ".github/x.yml",
        "../up.py": "../up.py",
        "/other/x.py": "/other/x.py",
        "./../x": "../x",
        "a//b.py": "a/b.py",
    }
    df = spark.createDataFrame([(p,) for p in cases], "file_path string").withColumn("given", F.col("file_path"))
    got = {r.given: r.file_path for r in ops.normalize_paths(df, root="/w/repo").collect()}
    assert got == cases


def test_gating(spark):
    rows = [("security_vulnerability", "info"), ("functional_bug", "odd"), ("code_quality", "high"), ("performance", "low")]
    df = spark.createDataFrame(rows, "issue_class string, severity string")
    gated = {r.issue_class: (r.is_fixable, r.gate_reason) for r in ops.gate_findings(df).collect()}
    assert gated == {
        "security_vulnerability": (False, "below minimum severity"),
        "functional_bug": (True, None),
        "code_quality": (False, "class is report-only"),
        "performance": (True, None),
    }
    more = {r.issue_class: r.is_fixable for r in ops.gate_findings(df, fix_code_quality=True, min_severity="medium").collect()}
    assert more == {"security_vulnerability": False, "functional_bug": False, "code_quality": True, "performance": False}


def test_lines_follow_python(spark):
    cases = ["", "a", "a\n", "a\r\nb", "a\rb\n\n", "x\x0by\x0cz", "p\x1cq\x85r s", "\n", "é\n b"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.lines(F.col("t"))).collect()] == [c.splitlines() for c in cases]
    padded = ["  a ", "\t\n a\x0b ", "\x1ca\xa0", ""]
    df = spark.createDataFrame([(c,) for c in padded], "t string")
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == [c.strip() for c in padded]


def test_number_lines_and_snippets(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\n",)], "t string")
    row = df.select(
        text.number_lines(F.col("t"), 2).alias("cut"),
        text.number_lines(F.col("t"), 4).alias("whole"),
        *[text.snippet(F.col("t"), F.lit(n).cast("int"), 1).alias(f"s{i}") for i, n in enumerate((1, 4, 5, 0, None))],
    ).first()
    assert row.cut == "1: a\n2: b\n... (2 more lines truncated)" and row.whole == "1: a\n2: b\n3: c\n4: d"
    assert (row.s0, row.s1, row.s2, row.s3, row.s4) == ("a\nb", "c\nd", "", "", "")


def test_path_functions(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), (".bashrc",), ("x/.hidden.py",), ("noext",), ("d.x/file",), ("A.PY",)], "p string")
    rows = df.select(text.suffix(F.col("p")), text.stem(F.col("p")), text.parent(F.col("p")), text.detect_language(F.col("p"))).collect()
    assert [r[0] for r in rows] == [".gz", "", ".py", "", "", ".PY"]
    assert [r[1] for r in rows] == ["b.tar", ".bashrc", ".hidden", "noext", "file", "A"]
    assert [r[2] for r in rows] == ["a", "", "x", "", "d.x", ""]
    assert [r[3] for r in rows] == [None, None, "python", None, None, None]


def test_corpus_keeps_package_files(corpus):
    kept = {r.path for r in corpus({
        "__init__.py": "", "a/_priv.py": "", ".hidden": "", ".git/x.py": "", "a/venv/y.py": "", "build/z.py": "",
        "a/build.py": "", "node_modules/m.js": "", "a/.tox/t.py": "",
    }).collect()}
    assert kept == {"__init__.py", "a/_priv.py", ".hidden", "a/build.py"}


def test_manifests_sort_by_path_parts(spark):
    paths = ["a-b/requirements.txt", "a/requirements.txt", "venv/requirements.txt", "requirements-dev.txt", "package.json", "x/package.json", "myrequirements.txt"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_key string, path string")
    found = file_source.find_manifests(df).collect()
    assert [r.path for r in sorted(found, key=lambda r: r.position) if r.kind == "requirements"] == [
        "a/requirements.txt", "a-b/requirements.txt", "requirements-dev.txt"
    ]
    assert [r.path for r in found if r.kind == "package_json"] == ["package.json"]


def test_broken_reports_give_no_rows(spark):
    df = spark.createDataFrame([("r", "req.txt", "not json"), ("r", "req.txt", "{}"), ("r", "req.txt", "[]")], "repo_key string, path string, document string")
    for read in (reports.read_bandit_report, reports.read_eslint_report, reports.read_pip_audit_report,
                 reports.read_npm_audit_report, reports.read_safety_report):
        assert read(df).count() == 0


def test_compiler_log_keeps_three_of_the_checked_file(spark):
    log = "\n".join(
        ["src/a.c:1:2: error: first", "src/a.c:2: fatal error: x.h: No such file or directory", "inc/b.h:9:1: error: elsewhere",
         "src/a.c:3: error: second", "src/a.c:4:1: warning: no", "src/a.c:5:1: fatal error: third", "src/a.c:6:1: error: fourth"]
    )
    df = spark.createDataFrame([("r", "src/a.c", log)], "repo_key string, path string, log string")
    assert sorted(r.line_number for r in reports.read_compiler_log(df).collect()) == [1, 3, 5]


def test_model_replies(spark):
    item = {"class": "Security", "severity": "HIGH", "line": "2", "title": "  t ", "description": "", "why": " w "}
    replies = [
        json.dumps([item, "noise", 3]),
        "text\n```json\n" + json.dumps({"results": [item]}) + "\n```",
        "I think [maybe] so: " + json.dumps([item]),
        "Answer: " + json.dumps({"candidates": [{**item, "line": 2.0, "class": "style"}, item]}),
        "```\n[]\n```",
        "no answer",
        "",
        None,
        json.dumps({"other": 1}),
        'So: [{"class": "style", "class": "security", "severity": "high", "line": 2, "title": "t", "why": "w", "score": NaN}]',
    ]
    rows = [("r", "f.py", "a\nb\nc", r, i) for i, r in enumerate(replies)]
    df = spark.createDataFrame(rows, "repo_key string, path string, content string, reply string, seq bigint")
    items, rejects = reports.read_model_findings(df)
    mapped = ops.map_model_findings(items).collect()
    # The first brackets of the third reply are no JSON, so its first object is taken,
    # which is not a list of findings.
    assert sorted(r.seq for r in mapped) == [0, 1, 3, 9]
    for row in mapped:
        assert (row.issue_class, row.severity, row.title, row.description, row.line_number) == ("security_vulnerability", "high", "t", "w", 2)
        assert row.code_snippet == "a\nb\nc" and row.root_cause is None and row.confidence == 0.8
    assert sorted(r.seq for r in rejects.collect()) == [5, 6, 7]


def test_search(spark):
    rows = [("r", f"i{i}", f"p{i}.py", 1, "functional_bug", t, s, 0, i) for i, (t, s) in enumerate([("Leak", "low"), ("other", "critical"), ("leaky", "high")])]
    df = spark.createDataFrame(rows, FINDING).withColumn("description", F.lit(None).cast("string"))
    hits = ops.search_findings(df, needle=" LEAK ").orderBy("position").collect()
    assert [r.finding_id for r in hits] == ["i2", "i0"]


def test_layout_helpers_on_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randrange(100), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(8)
    want: dict = {}
    for g, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        want.setdefault(g, []).append(i)
    order = [F.col("v").desc(), F.col("id")]
    got: dict = {}
    for r in rank_within(df, ["g"], order).collect():
        got[r.g, r.position] = r.id
    assert got == {(g, n): i for g, ids in want.items() for n, i in enumerate(ids, 1)}
    for k in (3, 1500):
        kept: dict = {}
        for r in top_per(df, ["g"], order, k, rank="n").collect():
            kept.setdefault(r.g, {})[r.n] = r.id
        assert {g: [m[n] for n in sorted(m)] for g, m in kept.items()} == {g: ids[:k] for g, ids in want.items()}
    lists = {r.g: r.ids for r in bounded_list(df, ["g"], order, "id", 4, "ids").collect()}
    assert lists == {g: ids[:4] for g, ids in want.items()}


def test_topological_levels_and_cycles(spark):
    nodes = spark.createDataFrame([("r", b, n) for b in "xyz" for n in "abcd"], "repo_key string, bucket string, node string")
    edges = spark.createDataFrame(
        [("r", "x", "a", "b"), ("r", "x", "b", "c"), ("r", "x", "a", "c"), ("r", "y", "a", "b"), ("r", "y", "b", "a"), ("r", "y", "c", "d")],
        "repo_key string, bucket string, before string, after string",
    )
    got = {(r.bucket, r.node): (r.level, r.cyclic) for r in planning.topological_levels(nodes, edges).collect()}
    assert {n: got["x", n] for n in "abcd"} == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (0, False)}
    assert all(got["y", n][1] for n in "abcd") and all(got["z", n] == (0, False) for n in "abcd")


def test_plan_order_puts_security_first_and_keeps_cyclic_input_order(spark):
    groups = spark.createDataFrame(
        [("r", f, s, (0, q)) for f, s, q in (("z", True, 5), ("y", False, 1), ("x", False, 3), ("w", False, 2), ("v", True, 9))],
        "repo_key string, file string, is_security boolean, first_seen struct<source_priority:int,seq:bigint>",
    )
    schema = "repo_key string, before string, after string"
    one_way = spark.createDataFrame([("r", "z", "v"), ("r", "y", "w"), ("r", "w", "x"), ("r", "z", "x")], schema)
    assert [r.file for r in planning.plan_order(groups, one_way).orderBy("position").collect()] == ["z", "v", "y", "w", "x"]
    ring = spark.createDataFrame([("r", "x", "w"), ("r", "w", "x"), ("r", "v", "z")], schema)
    assert [r.file for r in planning.plan_order(groups, ring).orderBy("position").collect()] == ["v", "z", "y", "w", "x"]


def _planned_at_random(spark, seed, files=24, links=60):
    rng = random.Random(seed)
    names = [f"svc/{'test_' if i % 5 == 0 else ''}m{i:02}.py" for i in range(files)]
    rows = [("r", *rng.sample(names, 2), "CALLS") for _ in range(links)]
    if seed % 2:  # no cycle
        rows = [(r, max(a, b), min(a, b), e) for r, a, b, e in rows]
    deps = spark.createDataFrame(rows * 2 + [("r", names[1], names[1], "CALLS")], "repo_key string, consumer string, dependency string, evidence string")
    groups = spark.createDataFrame(
        [("r", f, i % 3 == 0, (0, files - i)) for i, f in enumerate(names) if i % 7],
        "repo_key string, file string, is_security boolean, first_seen struct<source_priority:int,seq:bigint>",
    )
    clean = deps.where("consumer <> dependency").distinct()
    members = impact_members(impact_paths(clean, hops=2))
    pairs = planning.plan_dependencies(groups.withColumnRenamed("file", "file_path"), members).distinct()
    return deps, groups, members, pairs


def test_plan_without_rows_per_pair_agrees_with_pairs(spark, monkeypatch):
    for seed, slice_size in ((1, 512), (2, 2)):
        monkeypatch.setattr(planning, "_SLICE", slice_size)
        deps, groups, members, pairs = _planned_at_random(spark, seed)
        steps = planning.file_steps(deps)
        want = {tuple(r) for r in planning.plan_order(groups, pairs).collect()}
        assert {tuple(r) for r in planning.plan_order_within(groups, steps).collect()} == want
        ways = {(r.before, r.after) for r in pairs.collect()}
        before = planning.files_before(groups, steps)
        assert {(r.file, r.dependency_count) for r in planning.before_counts(*before).collect()} == {
            (f, sum(a == f for _, a in ways)) for _, f in ways
        }
        listed = {tuple(map(str, r)) for r in planning.item_dependencies(pairs, 2).collect()}
        assert {tuple(map(str, r)) for r in planning.before_parts(*before, 2).collect()} == listed
        near: dict = {}
        for r in sorted(members.where("not is_test").collect(), key=lambda r: (r.root, r.depth, r.path)):
            near.setdefault(r.root, []).append(r.node)
        assert {r.file: r.affected for r in planning.first_affected(steps, 3).collect()} == {f: n[:3] for f, n in near.items()}


def test_plan_levels_stop_at_cycles_and_ways_of_three(spark):
    deps = spark.createDataFrame(
        [("r", a, b) for a, b in (("b", "a"), ("c", "b"), ("d", "c"), ("f", "e"), ("e", "f"))], "repo_key string, consumer string, dependency string"
    )
    nodes = spark.createDataFrame([("r", "x", n) for n in "abcd"] + [("r", "y", n) for n in "ef"] + [("r", "z", "g")], "repo_key string, bucket string, node string")
    got = {r.node: (r.level, r.cyclic) for r in planning.levels_within(nodes, planning.file_steps(deps)).collect()}
    assert got == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (3, False), "e": (None, True), "f": (None, True), "g": (0, False)}
    far = nodes.where("node in ('a', 'd')")
    assert {r.level for r in planning.levels_within(far, planning.file_steps(deps)).collect()} == {0}


def test_cap_items(spark):
    items = spark.createDataFrame([("r", i, i % 2 == 0) for i in range(1, 8)], "repo_key string, position int, ok boolean")
    assert sorted(r.position for r in planning.cap_items(items, 2).collect()) == [1, 2, 3, 4]
    assert planning.cap_items(items, 0).count() == 7 and planning.cap_items(items, 9).count() == 7


def test_strategy_text_has_parts_and_keeps_every_line(spark):
    rows = [("r", f"i{i}", "f.py", i or None, "functional_bug", f"t{i}", "low", 0, i) for i in range(1500)]
    df = spark.createDataFrame(rows, FINDING)
    for name in ("suggested_fix", "root_cause", "description"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    planned = planning.plan_findings(df)
    parts = planning.fix_strategy(planned).orderBy("part").collect()
    assert [(p.part, p.finding_count) for p in parts] == [(0, 1500), (1, 1500)]
    assert parts[0].fix_strategy.startswith("Fix the following in this file:\n- t0: fix the issue\n- t1 (line 1): fix the issue")
    lines = [line for p in parts for line in p.fix_strategy.split("\n")[1:]]
    assert [line.split(" ")[1].rstrip(":") for line in lines] == [f"t{i}" for i in range(1500)]
    lists = publication.issue_lists(df).orderBy("part").collect()
    assert [i for p in lists for i in p.finding_ids] == [f"i{i}" for i in range(1500)]
    assert {p.finding_id for p in lists} == {"i0"} and {p.finding_count for p in lists} == {1500}
    files = spark.createDataFrame([("r", "f.py", "x = 1")], "repo_key string, path string, content string")
    none = spark.createDataFrame([], "repo_key string, path string, context string")
    requests = review.repair_requests(files, planning.fix_strategy(planned), none).orderBy("part").collect()
    assert [r.part for r in requests] == [0, 1] and "- t1499" in requests[1].request


def test_dependencies_of_an_item_have_parts(spark):
    edges = spark.createDataFrame([("r", f"b{i:04}", "z") for i in range(1200)], "repo_key string, before string, after string")
    parts = planning.item_dependencies(edges).orderBy("part").collect()
    assert [len(p.dependencies) for p in parts] == [1000, 200]
    assert [d for p in parts for d in p.dependencies] == [f"b{i:04}" for i in range(1200)]


def test_first_rows_of_a_group_with_a_map_column(spark):
    df = spark.createDataFrame([("g", i, {"a": str(i)}) for i in range(3000)], "g string, v int, m map<string,string>")
    assert sorted(r.v for r in top_per(df, ["g"], [F.col("v")], 2000).collect()) == list(range(2000))


def test_review_ranking_limits(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "python", 10), ("r", "b.py", "python", 60001), ("r", "c.py", "python", 0), ("r", "d.go", "go", 5), ("r", "e.js", "javascript", 20)],
        "repo_key string, path string, language string, size bigint",
    )
    edges = spark.createDataFrame([("r", "a.py", "b.py"), ("r", "a.py", "x")], "repo_key string, src string, dst string")
    ranked = review.rank_files_for_review(files, edges).orderBy("position").collect()
    assert [(r.path, r.degree) for r in ranked] == [("a.py", 2), ("e.js", 0)]
    assert [r.path for r in review.rank_files_for_review(files, edges, max_files=1).collect()] == ["a.py"]


def test_schemas_are_valid(spark):
    for ddl in (schemas.FILES, schemas.PARSED, schemas.NODES, schemas.EDGES, schemas.FINDINGS, schemas.MEMORY, schemas.APPLIED, schemas.EVENTS):
        assert spark.createDataFrame([], ddl).columns
