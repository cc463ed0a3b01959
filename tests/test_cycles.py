"""Components, witness cycles and their findings against brute force."""

from __future__ import annotations

import random

from faultatlas.operators import cycles
from faultatlas.operators.graph import cycle_findings
from faultatlas.plans.layout import cut

DEPS = "repo_key string, consumer string, dependency string"


def following(pairs):
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


def reach(steps, start):
    seen, todo = set(), [start]
    while todo:
        for b in steps.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def components(pairs):
    steps = following(pairs)
    far = {a: reach(steps, a) for a in steps}
    return {(min(b for b in far[a] if a in far.get(b, ())), a) for a in steps if any(b != a and a in far.get(b, ()) for b in far[a])}


def shortest_through(pairs, inside, start):
    """Least of the shortest cycles through a file, by a walk that keeps the least path of every file."""
    steps, best, paths = following(pairs), {start: [start]}, [[start]]
    while paths:
        grown: dict = {}
        for path in paths:
            for b in sorted(steps.get(path[-1], ())):
                if b in inside and (b == start or b not in best):
                    grown[b] = min(grown.get(b, [*path, b]), [*path, b])
        if start in grown:
            return grown[start][:-1]
        best.update(grown)
        paths = list(grown.values())
    return None


def test_components_equal_mutual_reach(spark):
    rng = random.Random(5)
    rows = []
    for repo, size, count in (("a", 30, 45), ("b", 60, 66), ("c", 20, 100), ("d", 12, 5)):
        names = [f"n{i:02d}" for i in range(size)]
        rng.shuffle(names)
        rows += [(repo, *pair) for pair in {(rng.choice(names), rng.choice(names)) for _ in range(count)}]
    # Two rings that a one-way bridge joins, with tails on both sides.
    ring = lambda name, n: [(f"{name}{i:02d}", f"{name}{(i + 1) % n:02d}") for i in range(n)]
    rows += [("e", a, b) for a, b in [*ring("p", 5), *ring("q", 7), ("q03", "p01"), ("t", "q00"), ("p02", "u")]]
    deps = spark.createDataFrame(rows, DEPS)
    got = {(r.repo_key, r.component, r.file) for r in cycles.cycle_components(deps).collect()}
    want = set()
    for repo in "abcde":
        pairs = {(a, b) for r, a, b in rows if r == repo and a != b}
        want |= {(repo, c, f) for c, f in components(pairs)}
    assert got == want and {c for r, c, _ in got if r == "e"} == {"p00", "q00"}
    assert cycles.cycle_components(deps.limit(0)).count() == 0


def test_rings_of_any_length_are_found(spark):
    names = [f"m{i:02d}" for i in range(50)]
    random.Random(2).shuffle(names)
    rows = [("five", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("five", "x", "y"), ("five", "y", "x")]
    rows += [("fifty", names[i], names[(i + 1) % 50]) for i in range(50)]
    deps = spark.createDataFrame(rows, DEPS)
    listed = cut(cycles.dependency_cycles(deps))
    found = {(r.repo_key, r.position): r.cycle for r in listed.collect()}
    assert found["five", 1] == ["x", "y"] and found["five", 2] == ["r0", "r1", "r2", "r3", "r4"]
    start = names.index("m00")
    assert found["fifty", 1] == names[start:] + names[:start] and len(found) == 3
    chains = {r.description for r in cycle_findings(listed).collect()}
    assert "Files form a circular import chain: r0 -> r1 -> r2 -> r3 -> r4" in chains and len(chains) == 3
    # Longer than the search goes: members are there, the cycle is not shown.
    members = cycles.cycle_components(deps)
    short = {r.component for r in cycles.witness_cycles(deps, members, longest=10).collect()}
    assert short == {"r0", "x"} and members.where("repo_key = 'fifty'").count() == 50


def test_witnesses_are_shortest_through_the_first_file(spark):
    rng = random.Random(9)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = {(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(40)) if a != b}
    deps = spark.createDataFrame([("r", a, b) for a, b in pairs], DEPS)
    members = cycles.cycle_components(deps)
    inside: dict = {}
    for r in members.collect():
        inside.setdefault(r.component, set()).add(r.file)
    got = {r.component: r.cycle for r in cycles.witness_cycles(deps, members).collect()}
    assert inside and got == {c: shortest_through(pairs, files, c) for c, files in inside.items()}


def test_repositories_with_enough_short_cycles_are_not_searched_further(spark, monkeypatch):
    rings = [(f"a{i:02}", f"b{i:02}") for i in range(12)]
    pairs = [("r", a, b) for a, b in rings] + [("r", b, a) for a, b in rings] + [(None, "x", "y"), (None, "y", "x")]
    pairs += [("r", x, y) for x, y in (("c", "d"), ("d", "e"), ("e", "c"))]
    deps = spark.createDataFrame(pairs, DEPS)

    def never(*_):
        raise AssertionError("searched although the first cycles are known")

    for name in ("_cycles_of_three", "_cycles_of_four"):
        monkeypatch.setattr("faultatlas.operators.graph." + name, never)
    monkeypatch.setattr(cycles, "cycle_components", never)
    got = {r.position: (r.repo_key, r.cycle) for r in cycles.dependency_cycles(deps).collect()}
    assert got == {i + 1: ("r", list(rings[i])) for i in range(10)}
