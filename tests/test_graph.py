"""Extraction, resolution and traversal on small sources."""

from __future__ import annotations

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultatlas.operators import graph, impact, python_source, reach, repo_map, resolution, text_patterns
from faultatlas.plans.layout import cut
from faultatlas.plans.repository_map import file_report, repository_map

SHOP = {
    "shop/rates.py": "def vat(x):\n    return x * 2\n",
    "shop/basket.py": "from shop.rates import vat\n\ndef total(x):\n    return vat(x)\n",
    "web/checkout.py": "from shop import basket\n\ndef pay(x):\n    return basket.total(x)\n",
    "tests/test_basket.py": "from shop.basket import total\n\ndef test_total():\n    assert total(1) == 2\n",
}


def members_of(files, hops=3):
    built = graph.build_graph(files)
    deps = graph.file_dependencies(built.edges)
    paths = impact.impact_paths(deps, hops=hops)
    return built, deps, impact.impact_members(paths)


def test_change_reaches_consumers_not_dependencies(corpus):
    files = corpus(SHOP)
    _, deps, members = members_of(files)
    rows = {r.file: r for r in impact.analyze_change(members, deps, files).collect()}
    rates, basket, checkout = (rows[f] for f in ("shop/rates.py", "shop/basket.py", "web/checkout.py"))
    assert (rates.direct_dependents, rates.file_count, rates.related_tests) == (1, 2, 1)
    assert rates.crosses_service_boundary and rates.confidence == "high"
    assert (basket.direct_dependencies, basket.file_count, basket.related_tests) == (1, 1, 1)
    assert (checkout.file_count, checkout.path_count, checkout.confidence) == (0, 0, "low")
    paths = {(r.root, r.node): r.path for r in members.collect()}
    assert paths["shop/rates.py", "web/checkout.py"] == ["shop/rates.py", "shop/basket.py", "web/checkout.py"]
    affected = {r.node for r in members.where("root = 'shop/rates.py' and not is_test").collect()}
    assert affected == {"shop/basket.py", "web/checkout.py"}


def test_unknown_seed_keeps_an_empty_row(spark, corpus):
    files = corpus(SHOP)
    _, deps, members = members_of(files)
    seeds = spark.createDataFrame([("r", "no\\such.py"), ("r", "shop\\rates.py")], "repo_key string, file string")
    rows = {r.file: r for r in impact.analyze_change(members, deps, files, seeds).collect()}
    assert rows["no/such.py"].file_count == 0 and rows["no/such.py"].confidence == "low"
    assert rows["no/such.py"].boundary_count == 0 and rows["shop/rates.py"].file_count == 2


def test_self_call_and_class_fallbacks(corpus):
    source = {
        "a.py": (
            "import b as helper\nfrom b import Tool\n\nclass Box:\n    def open(self):\n        self.turn()\n"
            "        helper.go()\n        Tool()\n        self.gone()\n        unknown()\n    def turn(self):\n        pass\n"
        ),
        "b.py": "class Tool:\n    pass\n\ndef go():\n    go()\n",
    }
    built = graph.build_graph(corpus(source))
    calls = {(r.src, r.dst) for r in built.edges.where("edge_type = 'CALLS'").collect()}
    assert calls == {
        ("a.py::Box.open", "a.py::Box.turn"),
        ("a.py::Box.open", "b.py::go"),
        ("a.py::Box.open", "b.py"),  # a class resolves to its file
    }
    missed = {tuple(r.chain) for r in built.unresolved_calls.collect()}
    assert missed == {("self", "gone"), ("unknown",)}


def test_import_forms(corpus):
    source = {
        "pkg/__init__.py": "",
        "pkg/core/__init__.py": "",
        "pkg/core/util.py": "def f():\n    pass\n",
        "pkg/core/near.py": "from . import util\nfrom .util import f as g\nfrom ..other import x\n\ndef h():\n    g()\n    util.f()\n",
        "pkg/other.py": "x = 1\n",
        "top.py": "import pkg.core.util\nfrom . import pkg2\nimport os.path\n\ndef k():\n    pkg.core.util.f()\n",
        "pkg2.py": "",
        "deep/path.py": "",
    }
    built = graph.build_graph(corpus(source))
    imports = {(r.src, r.dst) for r in built.edges.where("edge_type = 'IMPORTS' and dst_type = 'File'").collect()}
    assert imports == {
        ("pkg/core/near.py", "pkg/core/util.py"),
        ("pkg/core/near.py", "pkg/core/__init__.py"),
        ("pkg/core/near.py", "pkg/other.py"),
        ("top.py", "pkg/core/util.py"),
        ("top.py", "pkg2.py"),
        ("top.py", "deep/path.py"),  # os.path finds any path.py
    }
    calls = {(r.src, r.dst) for r in built.edges.where("edge_type = 'CALLS'").collect()}
    assert calls == {
        ("pkg/core/near.py::h", "pkg/core/util.py::f"),
        ("top.py::k", "pkg/core/util.py::f"),
    }
    strict = resolution.resolve_imports(
        resolution.import_refs(built.parsed), resolution.module_index(built.files), max_dropped=0
    )
    assert ("top.py", "deep/path.py") not in {(r.file, r.target) for r in strict.collect()}


def test_ambiguous_module_goes_to_smallest_path(corpus):
    files = corpus({"b/util.py": "", "a/util.py": "", "main.py": "import util\n"})
    built = graph.build_graph(files)
    assert [r.dst for r in built.edges.where("dst_type = 'File'").collect()] == ["a/util.py"]


def test_parse_failures_are_rows(corpus):
    deep = "x = " + "(" * 3000 + ")" * 3000
    files = corpus({"bad.py": "def f(:\n", "null.py": "a\x00b", "deep.py": deep, "ok.py": "x = 1\n"})
    found = {r.file_path: r for r in python_source.syntax_errors(python_source.parse_python(files)).collect()}
    assert set(found) == {"bad.py", "null.py", "deep.py"}
    assert found["bad.py"].line_number == 1 and found["bad.py"].title.startswith("Python syntax error: ")


def test_function_defined_twice_keeps_the_last(corpus):
    files = corpus({"a.py": "def f():\n    pass\n\n\ndef f():\n    if 1:\n        pass\n"})
    nodes = graph.build_graph(files).nodes.where("node_id = 'a.py::f'").collect()
    assert len(nodes) == 1 and nodes[0].attrs["line_start"] == "5" and nodes[0].attrs["complexity"] == "2"


def test_evidence_prefers_calls_then_tests(spark):
    rows = [("r", t, "a.py", "b.py") for t in ("IMPORTS", "CALLS", "TESTS")] + [("r", "IMPORTS", "c.py", "b.py"), ("r", "TESTS", "c.py", "b.py")]
    edges = spark.createDataFrame(rows, "repo_key string, edge_type string, src_file string, dst_file string")
    assert {(r.consumer, r.evidence) for r in graph.file_dependencies(edges).collect()} == {("a.py", "CALLS"), ("c.py", "TESTS")}


def test_blast_categories(spark):
    counts = spark.createDataFrame([(n,) for n in (0, 2, 3, 8, 9)], "n int")
    found = [r[0] for r in counts.select(impact.blast_category(F.col("n"))).collect()]
    assert found == ["narrow", "narrow", "moderate", "moderate", "wide"]


def walk(consumers: dict, root, hops: int) -> dict:
    """Breadth-first walk in sorted order, the model of impact_paths."""
    paths, frontier = {root: [root]}, [root]
    for _ in range(hops):
        following = []
        for node in frontier:
            for consumer in sorted(consumers.get(node, ())):
                if consumer not in paths:
                    paths[consumer] = paths[node] + [consumer]
                    following.append(consumer)
        frontier = following
    del paths[root]
    return paths


def test_impact_paths_equal_breadth_first_walk(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(30)]
    pairs = {(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(70)) if a != b}
    # One hub that a third of the files use and that uses others.
    pairs |= {(n, "n00") for n in nodes[1:11]} | {("n00", "n20"), ("n20", "n00")}
    deps = spark.createDataFrame([("r", a, b, "IMPORTS") for a, b in pairs], "repo_key string, consumer string, dependency string, evidence string")
    consumers: dict = {}
    for consumer, dependency in pairs:
        consumers.setdefault(dependency, set()).add(consumer)
    for hops in (1, 2, 3, 4):
        got = {(r.root, r.node): r.path for r in impact.impact_paths(deps, hops=hops).collect()}
        want = {(root, node): path for root in nodes for node, path in walk(consumers, root, hops).items()}
        assert got == want


def simple_cycles(pairs, longest: int):
    following: dict = {}
    for a, b in pairs:
        following.setdefault(a, set()).add(b)
    found = []

    def grow(path):
        for node in following.get(path[-1], ()):
            if node == path[0] and len(path) > 1:
                found.append(path)
            elif node > path[0] and node not in path and len(path) < longest:
                grow(path + [node])

    for start in sorted(following):
        grow([start])
    return sorted(found, key=lambda c: (len(c), c))


def test_cycles_equal_brute_force(spark):
    for seed, size, count in ((1, 8, 24), (2, 12, 40), (3, 6, 30)):
        rng = random.Random(seed)
        nodes = [f"n{i:02d}" for i in range(size)]
        pairs = {(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(count)) if a != b}
        deps = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_key string, consumer string, dependency string")
        for longest, limit in ((2, 10), (3, 10), (4, 10), (4, 3), (4, 1000)):
            got = [r.cycle for r in graph.circular_dependencies(deps, longest, limit).orderBy("position").collect()]
            assert got == simple_cycles(pairs, longest)[:limit], (seed, longest, limit)


def test_neighbours_go_both_ways(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "c", "b"), ("r", "c", "d"), ("q", "a", "z")], "repo_key string, src string, dst string")
    seeds = spark.createDataFrame([("r", "a")], "repo_key string, node_id string")
    got = {(r.node, r.distance) for r in graph.neighbours(edges, seeds, hops=3).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_map_hub_cap_edges(spark):
    files = [f"f{i:02d}.py" for i in range(30)]
    sizes = {"one": 1, "two": 2, "cap": 25, "over": 26}
    rows = [("r", f, c, "USES_CONFIG") for c, n in sizes.items() for f in files[:n]] + [("r", files[1], files[0], "IMPORTS")]
    edges = spark.createDataFrame(rows, "repo_key string, src string, dst string, edge_type string")
    shown = spark.createDataFrame([("r", f) for f in files], "repo_key string, path string")
    links = {(r.x, r.y): r.weight for r in repo_map.map_edges(edges, shown).collect()}
    assert len(links) == 25 * 24 // 2 + 1
    assert links[files[0], files[1]] == 2 and links[files[1], files[0]] == 3 and links[files[0], files[2]] == 1


def test_data_flow_falls_back_to_all_functions(spark, corpus):
    built = graph.build_graph(corpus({
        "a.py": "def one():\n    session.query(User)\n\n\ndef two():\n    one()\n",
        "b.py": "from a import one\n\ndef three():\n    one()\n",
    }))
    requests = spark.createDataFrame([("r", "a.py", 2), ("r", "a.py", 3), ("r", "a.py", None)], "repo_key string, file string, line int")
    flow = impact.trace_data_flow(requests, built.symbols, built.edges, graph.file_dependencies(built.edges))
    rows = {(r.line, r.role, r.node_id) for r in flow.collect()}
    assert {n for line, role, n in rows if line == 2 and role == "entry"} == {"a.py::one"}
    assert {n for line, role, n in rows if line == 3 and role == "entry"} == {"a.py::one", "a.py::two"}
    assert {n for line, role, n in rows if line is None and role == "entry"} == {"a.py::one", "a.py::two"}
    assert (2, "caller", "a.py::two") in rows and (2, "caller", "b.py::three") in rows
    assert (2, "callee", "DB:User") in rows and (2, "file_dependent", "b.py") in rows


def test_repositories_do_not_mix(spark, corpus):
    both = corpus(SHOP, "one").unionByName(corpus({"x.py": "import basket\nimport shop.basket\n"}, "two"))
    report = file_report(both)
    rows = {(r.repo_key, r.file): r.file_count for r in report.collect()}
    assert rows["one", "shop/rates.py"] == 2 and rows["two", "x.py"] == 0
    stats = {r.repo_key: r for r in repository_map(both).stats.collect()}
    assert stats["one"].files == 4 and stats["two"].files == 1 and not stats["one"].truncated


def test_no_file_ends_the_job(corpus, spark):
    deep = "@a" + ".b" * 6000 + "\ndef f():\n    pass\n"
    files = corpus({"deep.py": deep, "fine.py": "def g(x):\n    return x\n"})
    files = files.unionByName(files.limit(1).withColumn("path", F.lit("null.py")).withColumn("content", F.lit(None).cast("string")))
    rows = python_source.parse_python(files).select("file", "kind").distinct().collect()
    kinds = {(r.file, r.kind) for r in rows}
    assert ("fine.py", "symbol") in kinds and ("null.py", "error") in kinds
    assert any(file == "deep.py" for file, _ in kinds)


def test_patterns_know_letters_beyond_ascii(corpus):
    files = corpus({"a.py": '@äpp.get("/x")\nÄnder.objects.all()\nselect(Größe)\n'})
    scanned = text_patterns.scan_text(files)
    row = scanned.first()
    assert [(r.route, r.method) for r in row.routes] == [("/x", "GET")]
    assert set(row.models) == {"Änder", "Größe"}


DEPS = "repo_key string, consumer string, dependency string, evidence string"


def random_deps(spark, seed: int, size: int, count: int, kinds: list[str], repo: str = "r"):
    rng = random.Random(seed)
    names = [f"s{i % 4}/{'test_' if i % 5 == 0 else ''}m{i:03d}.py" for i in range(size)]
    pairs = {(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(count)) if a != b}
    rows = [(repo, a, b, rng.choice(kinds)) for a, b in sorted(pairs)]
    return spark.createDataFrame(rows, DEPS), spark.createDataFrame([(repo, n) for n in names], "repo_key string, path string")


def test_bitmaps_measure_what_paths_measure(spark, monkeypatch):
    """Also with blocks that split groups, hubs merged in slices and evidence that only paths settle."""
    weak = ["IMPORTS"] * 8
    for seed, size, count, kinds, block in ((1, 40, 70, [*weak, "CALLS"], 8192), (2, 60, 400, ["IMPORTS", "CALLS", "TESTS"], 16), (3, 30, 35, weak, 8)):
        monkeypatch.setattr(reach, "BLOCK", block)
        monkeypatch.setattr(reach, "_SLICE", 3)
        deps, files = random_deps(spark, seed, size, count, kinds)
        for hops in (1, 3):
            members = impact.impact_members(impact.impact_paths(deps, hops=hops))
            want = {tuple(r) for r in impact.analyze_change(members, deps, files).collect()}
            assert {tuple(r) for r in reach.reach_summary(deps, files, hops).collect()} == want


def test_blast_counts_equal_distinct_members(spark, monkeypatch):
    monkeypatch.setattr(reach, "BLOCK", 16)
    rng = random.Random(4)
    deps, files = random_deps(spark, 5, 40, 90, ["CALLS"])
    names = [r.path for r in files.collect()]
    kinds = {"Function": "f", "APIEndpoint": "a", "DBModel": "d", "Class": "c"}
    rows = [("r", n, f"{k}{rng.randint(0, 60)}", kind, "CALLS") for n in names for kind, k in kinds.items() for _ in range(3)]
    edges = spark.createDataFrame(rows, "repo_key string, src_file string, dst string, dst_type string, edge_type string")
    for hops in (1, 2):
        members = impact.impact_members(impact.impact_paths(deps, hops=hops))
        analysed = impact.analyze_change(members, deps, files)
        want = impact.blast_radius(analysed, impact.blast_members(members, files, edges))
        assert {tuple(r) for r in reach.blast_report(deps, files, edges, hops).collect()} == {tuple(r) for r in want.collect()}


def test_sets_move_by_block_and_keep_only_their_words(spark):
    """No row per dependency and block is moved, and a set far behind in its block is no longer than one in front."""
    deps, _ = random_deps(spark, 8, 30, 80, ["CALLS"])
    steps = deps.selectExpr("repo_key", "cast(right(consumer, 6) as string) as n", "dependency").selectExpr(
        "repo_key", "xxhash64(n) as node", "xxhash64(right(dependency, 6)) as via"
    )
    own = cut(steps.selectExpr("repo_key", "node", "pmod(node, 2) as block", "cast(511 as bigint) as place"))
    sets = reach.spread(own, steps, 3)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert [f.dataType.simpleString() for f in sets.schema.fields[3:]] == ["bigint"] * 8
    assert {r.w7 for r in sets.collect()} == {-(2**63)} and {r.w0 for r in sets.collect()} == {0}
    by_node = re.findall(r"hashpartitioning\(repo_key#\d+, node#\d+L?, block#\d+L?", plan)
    assert len(by_node) == 1  # the marks themselves


def test_a_hub_makes_no_pairs(spark):
    """1,500 files use a hub that uses 1,500 others: counts come without 2 million rows."""
    rows = [("r", f"in/m{i:04d}.py", "hub/h.py", "IMPORTS") for i in range(1500)]
    rows += [("r", "hub/h.py", f"out/m{i:04d}.py", "IMPORTS") for i in range(1500)]
    deps = spark.createDataFrame(rows, DEPS)
    files = deps.select("repo_key", F.explode(F.array("consumer", "dependency")).alias("path")).distinct()
    found = {r.file: r for r in reach.reach_summary(deps, files, 3).collect()}
    assert len(found) == 3001
    assert (found["out/m0007.py"].path_count, found["out/m0007.py"].boundary_count) == (1501, 3)
    assert (found["hub/h.py"].path_count, found["in/m0001.py"].path_count) == (1500, 0)
    sets = reach.impact_boundaries(deps, 3)
    assert {(r.service_boundary, r.n) for r in sets.where("file = 'out/m0007.py'").collect()} == {("hub", 1), ("in", 1500)}
    assert sets.count() == 2 * 1500 + 1


def test_first_tests_and_related_files_equal_the_whole_impact(spark):
    for seed, size, count in ((6, 40, 60), (7, 40, 300)):
        deps, files = random_deps(spark, seed, size, count, ["CALLS"])
        members = impact.impact_members(impact.impact_paths(deps, hops=3)).collect()
        pairs = {(r.consumer, r.dependency) for r in deps.collect()}
        got, related = {}, {}
        for r in reach.first_reached(deps, impact.text.is_python_test(F.col("consumer")), 4, 3).collect():
            got.setdefault(r.file, {})[r.position] = r.node
        for r in impact.related_files(deps, files, limit=6).collect():
            related.setdefault(r.file, {})[r.position] = r.related
        for (root,) in {(r.path,) for r in files.collect()}:
            own = [m for m in members if m.root == root]
            tests = sorted(m.node for m in own if m.is_test)[:4]
            assert got.get(root, {}) == dict(enumerate(tests, 1))
            order = sorted(b for a, b in pairs if a == root) + sorted(m.node for m in own if m.depth == 1 and not m.is_test)
            order += sorted(m.node for m in own if m.is_test) + [m.node for m in sorted(own, key=lambda m: (m.depth, m.path)) if not m.is_test and m.depth > 1]
            assert related.get(root, {}) == dict(enumerate(list(dict.fromkeys(order))[:6], 1))


def test_places_meet_spans_by_block(spark):
    """Nested, long, empty and backward spans; lines on the edges of blocks; null lines."""
    rng = random.Random(8)
    spans = [("r", f"f{i % 3}.py", f"s{i}", a := rng.randint(1, 400), a + rng.choice([-3, 0, 1, 31, 32, 33, 200])) for i in range(120)]
    places = [("r", f"f{i % 4}.py", rng.choice([None, 0, 31, 32, 33, 64, 500, *range(1, 60)])) for i in range(200)] + [("q", "f0.py", 5)]
    functions = spark.createDataFrame(spans, "repo_key string, file string, symbol_id string, line_start int, line_end int")
    asked = spark.createDataFrame(places, "repo_key string, file string, line int").distinct()
    want = set()
    for repo, file, line in set(places):
        own = [s for s in spans if s[:2] == (repo, file)]
        near = [s for s in own if line is not None and s[3] <= line <= s[4]]
        want |= {(repo, file, line, s[2]) for s in near or own}
    rows = [tuple(r) for r in impact.flow_entries(asked, functions).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_facts_of_a_huge_source_come_in_small_batches():
    content = "".join(f"import m{i}\n" for i in range(9_000))
    sources = pa.RecordBatch.from_pydict({"repo_key": ["r"] * 3, "path": ["a.py", "b.py", "c.py"], "content": [content, None, "def f(:"]})
    batches = list(python_source._parse_task(errors_only=False)(iter([sources])))
    assert max(b.num_rows for b in batches) <= 2_000
    rows = [row for b in batches for row in b.to_pylist()]
    assert [r["ord"] for r in rows] == [*range(9_000), 0, 0]
    assert [r["kind"] for r in rows[-2:]] == ["error", "error"]


def test_places_with_several_entries_meet_a_caller_once(corpus, capsys):
    files = corpus({
        "a.py": "def f(x):\n    return x\n\ndef g(x):\n    return x\n",
        "b.py": "from a import f, g\n\ndef h(x):\n    return f(x) + g(x)\n",
    })
    built = graph.build_graph(files)
    requests = files.sparkSession.createDataFrame([("r", "a.py", None), ("r", "a.py", 2), ("r", "a.py", 2), ("r", "b.py", 1)], "repo_key string, file string, line int")
    flow = impact.trace_data_flow(requests, built.symbols, built.edges, graph.file_dependencies(built.edges))
    flow.explain()
    plan = [line for line in capsys.readouterr().out.splitlines() if "- " in line]
    got = [(r.file, r.line, r.role, r.node_id) for r in flow.collect()]
    assert sorted(got, key=str) == sorted([
        ("a.py", None, "entry", "a.py::f"), ("a.py", None, "entry", "a.py::g"), ("a.py", None, "caller", "b.py::h"),
        ("a.py", None, "file_dependent", "b.py"), ("a.py", 2, "entry", "a.py::f"), ("a.py", 2, "caller", "b.py::h"),
        ("a.py", 2, "file_dependent", "b.py"), ("b.py", 1, "entry", "b.py::h"), ("b.py", 1, "callee", "a.py::f"),
        ("b.py", 1, "callee", "a.py::g"), ("b.py", 1, "file_dependency", "a.py"),
    ], key=str)
    # The rows of all roles are not dealt out once more to be compared.
    assert "Union" in plan[0]


def test_a_worker_parses_in_children_that_end(monkeypatch):
    """The parser never lets go of the names it reads, so no process parses more than one batch of files."""
    sources = pa.record_batch({"repo_key": ["r"] * 3, "path": ["a.py", "b.py", "c.py"], "content": ["x = 1\n", "def f(:\n", None]})
    monkeypatch.setattr(python_source, "_facts", lambda path, content: [{"kind": "error", "name": path, "line_start": os.getpid()}])
    for errors_only in (False, True):
        batches = list(python_source._parse_task(errors_only)(iter([sources, sources.slice(0, 0), sources.slice(1)])))
        rows = [row for batch in batches for row in batch.to_pylist()]
        assert [row["name"] for row in rows] == ["a.py", "b.py", "c.py", "b.py", "c.py"]
        first, second = {row["line_start"] for row in rows[:3]}, {row["line_start"] for row in rows[3:]}
        assert len(first) == len(second) == 1 and len(first | second | {os.getpid()}) == 3
    taken = python_source._parse_task(errors_only=False)(iter([sources] * 3))
    next(taken)
    taken.close()
    monkeypatch.setattr(python_source, "_facts", lambda path, content: os._exit(3))
    with pytest.raises((RuntimeError, pa.ArrowInvalid)):
        list(python_source._parse_task(errors_only=False)(iter([sources])))
