"""Walks range by range against brute force, and what moves for them."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from faultatlas.operators import graph, impact, planning, python_source, ranges, reach, text_patterns

DEPS = "repo_key string, consumer string, dependency string, evidence string"


@pytest.fixture(params=[8_192, 16])
def one_or_many(request, monkeypatch):
    """All numbers in one range, and few in each; lists of ends in several arrays."""
    monkeypatch.setattr(ranges, "RANGE", request.param)
    monkeypatch.setattr(reach, "_SLICE", 3)


def _two_repositories(seed, size=40, count=90):
    """The same names in two repositories, with repeated rows, uses of itself and unknown ends."""
    rng = random.Random(seed)
    names = [f"s{i % 3}/{'test_' if i % 6 == 0 else ''}m{i:02d}.py" for i in range(size)]
    pairs = {repo: {(rng.choice(names), rng.choice(names)) for _ in range(count)} for repo in ("r", "q")}
    rows = [(repo, a, b, "CALLS") for repo, found in pairs.items() for a, b in found] * 2
    return names, pairs, [*rows, ("r", names[1], names[1], "CALLS"), ("r", None, names[1], "CALLS"), (None, names[2], names[1], "CALLS")]


def _far(steps, root, hops):
    """Least distance of all that is reached, the root not counted."""
    far = {root: 0}
    for hop in range(1, hops + 1):
        for a in [n for n, d in far.items() if d == hop - 1]:
            for b in steps.get(a, ()):
                far.setdefault(b, hop)
    del far[root]
    return far


def _users(found):
    users: dict = {}
    for consumer, dependency in found:
        users.setdefault(dependency, set()).add(consumer)
    return users


def test_pairs_without_paths(spark, one_or_many):
    names, pairs, rows = _two_repositories(11)
    deps = spark.createDataFrame(rows, DEPS)
    seeds = spark.createDataFrame([("r", n.replace("/", "\\")) for n in names[:25]] + [("q", names[3]), ("q", None), (None, names[2]), ("q", "none.py")], "repo_key string, file string")
    for hops in (1, 3):
        want = {("r", n, m, d) for n in names[:25] for m, d in _far(_users(pairs["r"]), n, hops).items()}
        want |= {("q", names[3], m, d) for m, d in _far(_users(pairs["q"]), names[3], hops).items()}
        found = impact.impact_members(impact.impact_paths(deps, seeds, hops, paths=False)).collect()
        assert sorted((r.repo_key, r.root, r.node, r.depth) for r in found) == sorted(want)
        everything = impact.impact_paths(deps, None, hops, paths=False)
        assert everything.count() == sum(len(_far(_users(pairs[repo]), n, hops)) for repo in pairs for n in names)


def test_boundaries_of_two_repositories(spark, one_or_many):
    names, pairs, rows = _two_repositories(12)
    found = reach.impact_boundaries(spark.createDataFrame(rows, DEPS), 3).collect()
    got: dict = {}
    for r in found:
        if r.repo_key:
            key = r.repo_key, r.file, r.service_boundary, r.is_test
            got[key] = got.get(key, 0) + r.n
    want: dict = {}
    for repo, of_repo in pairs.items():
        for n in names:
            for m in _far(_users(of_repo), n, 3):
                key = repo, n, m.split("/")[0], "test_" in m
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_members_keep_unknown_kinds_and_names(spark, one_or_many):
    rng = random.Random(13)
    files, kinds = [f"f{i}" for i in range(12)], ("Function", "APIEndpoint", "DBModel", "File")
    rows = [(rng.choice("rq"), rng.choice(files), rng.choice([None, *(f"n{i}" for i in range(30))]), rng.choice(kinds), rng.choice(["CALLS", "DEFINES", None])) for _ in range(200)]
    edges = spark.createDataFrame(rows, "repo_key string, src_file string, dst string, dst_type string, edge_type string")
    near = {("r", f, rng.choice(files)) for f in files[:9] for _ in range(4)}
    members = spark.createDataFrame([(*x, False) for x in near] * 2 + [("r", "f1", "f11", True)], "repo_key string, root string, node string, is_test boolean")
    paths = spark.createDataFrame([("r", f) for f in files] + [("q", "f0")], "repo_key string, path string")
    want = set()
    for repo, root in [("r", f) for f in files] + [("q", "f0")]:
        ring = {root} | {n for r, a, n in near if (r, a) == (repo, root)}
        shapes: dict = {}
        for r, file, dst, kind, edge in rows:
            if r == repo and file in ring and kind != "File":
                shapes.setdefault((dst, kind), []).append(None if edge is None else edge == "CALLS")
        for (dst, kind), judged in shapes.items():
            known = [j for j in judged if j is not None]
            want.add((repo, root, dst, kind, all(known) if known else None))
    found = [tuple(r) for r in impact.blast_members(members, paths, edges).select("repo_key", "file", "node_id", "node_type", "is_callee").collect()]
    assert len(found) == len(want) and set(found) == want


def test_sets_and_lists_do_not_move(spark):
    """Links go to the ranges that they reach; neither a set by node and block nor a list per root is moved."""
    names, _, rows = _two_repositories(14)
    deps = spark.createDataFrame(rows, DEPS)
    edges = deps.select("repo_key", F.col("consumer").alias("src"), F.col("dependency").alias("dst"))
    seeds = spark.createDataFrame([("r", n) for n in names], "repo_key string, node_id string")
    for found in (reach.impact_boundaries(deps, 3), graph.neighbours(edges, seeds, 2), impact.impact_paths(deps, hops=3, paths=False)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "hashpartitioning(range" in plan and "hashpartitioning(root" not in plan


def test_lists_before_a_file_are_moved_once(spark):
    rows = [("r", f"b{i:03d}", f"a{i % 3}") for i in range(100)] * 2
    pairs = spark.createDataFrame(rows, "repo_key string, before string, after string")
    listed = planning.item_dependencies(pairs, 7)
    assert listed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.file, r.part): r.dependencies for r in listed.collect()}
    for k in range(3):
        want = [f"b{i:03d}" for i in range(100) if i % 3 == k]
        assert [x for part in sorted(p for f, p in got if f == f"a{k}") for x in got[f"a{k}", part]] == want
    assert max(map(len, got.values())) == 7


def test_patterns_look_for_their_text_first(spark):
    sources = ['@a.GET("/x")', '@a.route ("/y")', 'path("z")', "M.objects.get", "session.query(Q)", "x.query(R)", "select(S)",
               'os.environ.get("A")', 'os.environ["B"]', 'config["C"]', 'config.get("D")', "nothing", None]
    files = spark.createDataFrame([("r", f"f{i}.py", "python", t) for i, t in enumerate(sources)], "repo_key string, path string, language string, content string")
    scanned = text_patterns.scan_text(files)
    assert scanned._jdf.queryExecution().optimizedPlan().toString().lower().count("contains") >= 10
    rows = {r.file: r for r in scanned.collect()}
    assert [[x.route for x in rows[f"f{i}.py"].routes] for i in range(3)] == [["/x"], ["/y"], ["z"]]
    assert [rows[f"f{i}.py"].models for i in range(3, 7)] == [["M"], ["Q"], ["R"], ["S"]]
    assert [rows[f"f{i}.py"].settings for i in range(7, 11)] == [["A"], ["B"], ["C"], ["D"]]
    assert rows["f11.py"].routes == [] and rows["f12.py"].routes is None


def test_marks_without_anything_below_are_not_walked():
    assert python_source._children(ast.Name) == () and python_source._children(ast.BinOp) == ("left", "right")
    calls = [n for n in python_source._below(ast.parse("a(b)[c(d) < e(f).g(h)]")) if isinstance(n, ast.Call)]
    assert [n.lineno for n in calls] == [1] * 4
