"""The last step of walks by arrays, and by rows for roots that lead to too much."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultatlas.operators import graph, impact, lists, reach

DEPS = "repo_key string, consumer string, dependency string, evidence string"


def _pairs(seed, size=24, count=60):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(size)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(count)}
    return names, pairs | {(n, "n00") for n in names[1:9]} | {("n03", "n03")}


@pytest.fixture(params=[65_536, 40, 1])
def wide(request, monkeypatch):
    """All roots by arrays, some, and all by rows; lists in several arrays."""
    monkeypatch.setattr(lists, "WIDE", request.param)
    monkeypatch.setattr(lists, "_SLICE", 3)


def _rounds(steps, root, hops):
    """Least distance of all that is reached, the root not counted."""
    far = {root: 0}
    for hop in range(1, hops + 1):
        for a in [n for n, d in far.items() if d == hop - 1]:
            for b in steps.get(a, ()):
                far.setdefault(b, hop)
    del far[root]
    return far


def test_neighbours_by_arrays(spark, wide):
    names, pairs = _pairs(1)
    steps: dict = {}
    for a, b in pairs:
        if a != b:
            steps.setdefault(a, set()).add(b)
            steps.setdefault(b, set()).add(a)
    rows = [("r", a, b) for a, b in pairs] * 2 + [("r", None, "n01"), (None, "n01", "n02")]
    edges = spark.createDataFrame(rows, "repo_key string, src string, dst string")
    seeds = spark.createDataFrame([("r", n) for n in names] + [("r", "n01"), ("r", "none"), (None, "n01"), ("r", None)], "repo_key string, node_id string")
    for hops in (1, 2, 3):
        got = sorted(tuple(r) for r in graph.neighbours(edges, seeds, hops).select("repo_key", "seed", "node", "distance").collect())
        assert got == sorted(("r", n, to, d) for n in names for to, d in _rounds(steps, n, hops).items())


def test_paths_by_arrays(spark, wide):
    names, pairs = _pairs(2)
    users: dict = {}
    for consumer, dependency in pairs:
        users.setdefault(dependency, set()).add(consumer)
    rows = [("r", a, b, e) for a, b in pairs for e in ("IMPORTS", "CALLS")] + [("r", None, "n01", "CALLS"), (None, "n02", "n01", "CALLS")]
    deps = spark.createDataFrame(rows, DEPS)
    seeds = spark.createDataFrame([("r", n) for n in names], "repo_key string, file string")
    for hops in (2, 3):
        want: dict = {}
        for root in names:
            best, frontier = {}, [(root,)]
            for _ in range(hops):
                grown: dict = {}
                for path in frontier:
                    for c in users.get(path[-1], ()):
                        if c not in best and (c != root or len(path) == 1):
                            grown[c] = min(grown.get(c, (*path, c)), (*path, c))
                best.update(grown)
                frontier = list(grown.values())
            want |= {(root, c): (len(p) - 1, list(p), "CALLS") for c, p in best.items()}
        found = [r for r in impact.impact_paths(deps, seeds, hops, by_lists=True).collect() if r.node is not None]
        assert len(found) == len(want)
        assert {(r.root, r.node): (r.depth, list(r.path), r.evidence) for r in found} == want


def test_blast_members_by_arrays(spark, wide):
    rows = [("r", "a", "b", "CALLS", "a", "Function"), ("r", "a2", "b", "DEFINES", "b", "Function"), ("r", "a", "c", "CALLS", "a", "Function"),
            ("r", "b", "c", None, "b", "Function"), ("r", "b", "d", None, "b", "DBModel"), ("r", "b", "e", "IMPORTS", "b", "File"),
            ("r", "b", None, "CALLS", "b", "Function"), ("r", "b", "f", "CALLS", None, "Function"), (None, "b", "g", "CALLS", "b", "Function")]
    edges = spark.createDataFrame(rows, "repo_key string, src string, dst string, edge_type string, src_file string, dst_type string")
    files = spark.createDataFrame([("r", f) for f in "abz"] * 2, "repo_key string, path string")
    members = spark.createDataFrame([("r", "a", "b", False), ("r", "z", "b", True)], "repo_key string, root string, node string, is_test boolean")
    got = sorted(map(repr, (tuple(r) for r in impact.blast_members(members, files, edges).drop("repo_key").collect())))
    of_b = [("b", "Function", False), ("c", "Function", None), ("d", "DBModel", None), (None, "Function", True)]
    of_a = [("b", "Function", False), ("c", "Function", True), ("d", "DBModel", None), (None, "Function", True)]
    assert got == sorted(map(repr, [("a", *x) for x in of_a] + [("b", *x) for x in of_b]))


@pytest.mark.parametrize("slice_size", [512, 2])
def test_first_reached_by_arrays(spark, monkeypatch, slice_size):
    monkeypatch.setattr(reach, "_SLICE", slice_size)
    names, pairs = _pairs(3)
    users: dict = {}
    for consumer, dependency in pairs:
        users.setdefault(dependency, set()).add(consumer)
    rows = [("r", a, b, "CALLS") for a, b in pairs] * 2 + [("r", None, "n01", "CALLS"), (None, "n02", "n01", "CALLS")]
    found = reach.first_reached(spark.createDataFrame(rows, DEPS), F.col("consumer") > "n05", 3, 3).where("repo_key = 'r'")
    want = []
    for root in names:
        far = sorted(n for n in _rounds(users, root, 3) if n > "n05")
        want += [(root, i + 1, n) for i, n in enumerate(far[:3])]
    assert sorted((r.file, r.position, r.node) for r in found.collect()) == want
