"""What a change can affect - bounded traversals for all files at once.

Results are long tables, one row per (file, member).  A file that a third of the
corpus depends on has that many rows, never one giant array; arrays appear only
where the operator itself has a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.operators.lists import lists_of, split, wide_roots
from faultatlas.operators import ranges
from faultatlas.operators.reach import by_number, first_reached, numbered, reach_pairs
from faultatlas.plans.layout import bounded_list, cut, top_per

_STRONG = ("CALLS", "TESTS")
# Lines per block in which spans and places meet: about the length of a function.
LINE_BLOCK = 32


def impact_paths(deps: DataFrame, seeds: DataFrame | None = None, hops: int = 3, by_lists: bool = False, paths: bool = True) -> DataFrame:
    """(root, node, depth, path, evidence), each node once per root.

    Impact runs from a dependency to its consumers.  The first path of a
    breadth-first walk that expands in sorted order is the least path of the least
    depth, so one ``min`` per (root, node) both removes visited nodes and picks
    the path.  ``deps`` is read once per level; materialise it if it is costly.
    ``seeds`` (repo_key, file) limits the roots.  ``by_lists`` finds the last of several
    levels by arrays, which moves less and takes more time where files reach most others.
    Without ``paths`` only the pairs and their depth are found, by bitmaps.
    """
    if not paths:
        asked = None if seeds is None else seeds.select("repo_key", text.posix(F.col("file")).alias("root"))
        steps = deps.select("repo_key", F.col("dependency").alias("node"), F.col("consumer").alias("via"))
        return reach_pairs(steps, hops, asked)
    first = deps.select(
        "repo_key",
        F.col("dependency").alias("root"),
        F.col("consumer").alias("node"),
        F.lit(1).alias("depth"),
        F.array("dependency", "consumer").alias("path"),
        "evidence",
    )
    if seeds is not None:
        roots = seeds.select("repo_key", text.posix(F.col("file")).alias("root")).distinct()
        first = first.join(roots, ["repo_key", "root"], "left_semi")
    if hops < 1:
        return first.limit(0)
    reached = first
    step = deps.select(
        "repo_key", F.col("dependency").alias("node"), "consumer", F.col("evidence").alias("_evidence")
    )
    if hops == 1:
        return reached
    for depth in range(2, hops if by_lists else hops + 1):
        reached = _least(reached.unionByName(_grown(reached, step, depth)))
        if depth < hops:
            reached = cut(reached)
    if not by_lists:
        return reached
    if hops == 2:
        reached = cut(_least(first))
    return reached.unionByName(_last_paths(reached, step, hops))


def _grown(reached: DataFrame, step: DataFrame, depth: int) -> DataFrame:
    """Every path of ``depth`` steps that goes on from the rows of ``reached``."""
    return (
        reached.where(F.col("depth") == depth - 1)
        .join(step, ["repo_key", "node"])
        .where(F.col("consumer") != F.col("root"))
        .select(
            "repo_key",
            "root",
            F.col("consumer").alias("node"),
            F.lit(depth).alias("depth"),
            F.concat("path", F.array("consumer")).alias("path"),
            F.col("_evidence").alias("evidence"),
        )
    )


def _least(paths: DataFrame) -> DataFrame:
    return (
        paths.groupBy("repo_key", "root", "node")
        .agg(F.min(F.struct("depth", "path", "evidence")).alias("best"))
        .select("repo_key", "root", "node", "best.*")
    )


def _last_paths(reached: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """The rows of ``impact_paths`` at depth ``hops``, from all that are nearer.

    Most rows are found here, so a node hands its consumers to a root as one array, with
    the path that leads to it.  The task of the root sorts the paths, then all consumers
    by name and place of their path: the first of each name has the least path, and one
    whose first place is a row of ``reached`` is not new.
    """
    user = F.struct(F.col("consumer").alias("node"), F.col("_evidence").alias("evidence"))
    arrays = lists_of(step.where(F.col("consumer").isNotNull()), user, F.col("consumer"))
    ring = reached.where(F.col("depth") == hops - 1)
    wide = wide_roots(ring.select("repo_key", "root", "node"), arrays, reached)
    (narrow_ring, wide_ring), (narrow, wide_reached) = split(ring, wide), split(reached, wide)
    itself = F.struct("node", F.lit(None).cast("string").alias("evidence"))
    met = narrow_ring.join(arrays, ["repo_key", "node"]).select(
        "repo_key", "root", F.struct(F.lit(True).alias("new"), "path", "values").alias("way")
    )
    known = narrow.select(
        "repo_key", "root",
        F.struct(F.lit(False).alias("new"), F.lit(None).cast("array<string>").alias("path"), F.array(itself).alias("values")).alias("way"),
    )
    at_root = met.unionByName(known).repartition("repo_key", "root").groupBy("repo_key", "root")
    opened = at_root.agg(F.sort_array(F.collect_list("way")).alias("ways"))
    placed = F.transform(
        "ways",
        lambda way, at: F.transform(way["values"], lambda u: F.struct(u["node"].alias("node"), at.alias("at"), u["evidence"].alias("evidence"))),
    )
    opened = opened.select("repo_key", "root", "ways", F.sort_array(F.flatten(placed)).alias("users"))
    fresh = F.filter(
        "users",
        lambda u, i: ((i == 0) | (u["node"] != F.get(F.col("users"), i - 1)["node"]))
        & F.get(F.col("ways"), u["at"])["new"]
        & (u["node"] != F.col("root")),
    )
    found = F.transform(
        fresh,
        lambda u: F.struct(
            u["node"].alias("node"), F.concat(F.get(F.col("ways"), u["at"])["path"], F.array(u["node"])).alias("path"), u["evidence"].alias("evidence")
        ),
    )
    by_lists = opened.select("repo_key", "root", F.explode(found).alias("found")).select(
        "repo_key", "root", "found.node", F.lit(hops).alias("depth"), "found.path", "found.evidence"
    )
    by_rows = _least(_grown(wide_ring, step, hops)).join(wide_reached, ["repo_key", "root", "node"], "left_anti")
    return by_lists.unionByName(by_rows)


def impact_members(paths: DataFrame) -> DataFrame:
    """Impacted files with what the reports ask of them: test or not, boundary.

    Both follow from the path, so this is a projection and not a join.
    """
    node = F.col("node")
    return paths.select(
        "*",
        text.is_python_test(node).alias("is_test"),
        text.service_boundary(node).alias("service_boundary"),
    )


def analyze_change(members: DataFrame, deps: DataFrame, files: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One row per file with the measures of its impact.

    Lists are the rows of ``impact_members``.  A seed that is no file of its
    repository keeps a row with zeros and confidence ``low``.
    """
    production = ~F.col("is_test")
    per_root = members.groupBy("repo_key", F.col("root").alias("file")).agg(
        F.count_if(production).alias("file_count"),
        F.count_if(production & (F.col("depth") == 1)).alias("direct_dependents"),
        F.count_if(F.col("is_test")).alias("related_tests"),
        F.count(F.lit(1)).alias("path_count"),
        F.bool_or(F.col("evidence").isin(*_STRONG)).alias("_strong"),
        F.count_distinct(F.when(production, F.col("service_boundary"))).alias("module_count"),
        F.bool_or(production & (F.col("service_boundary") == text.service_boundary(F.col("root")))).alias("_home_hit"),
    )
    outward = deps.groupBy("repo_key", F.col("consumer").alias("file")).agg(
        F.count(F.lit(1)).alias("direct_dependencies")
    )
    known = files.select("repo_key", F.col("path").alias("file"), F.lit(True).alias("_known"))
    if seeds is None:
        wanted = known
    else:
        wanted = seeds.select("repo_key", text.posix(F.col("file")).alias("file")).distinct().join(
            known, ["repo_key", "file"], "left"
        )
    joined = wanted.join(per_root, ["repo_key", "file"], "left").join(outward, ["repo_key", "file"], "left")
    counts = ["file_count", "direct_dependents", "related_tests", "path_count", "module_count", "direct_dependencies"]
    home_is_new = F.col("_known") & ~F.coalesce(F.col("_home_hit"), F.lit(False))
    boundary_count = F.col("module_count") + F.when(home_is_new, 1).otherwise(0)
    files_hit = F.col("file_count")
    return joined.fillna(0, counts).select(
        "repo_key",
        "file",
        *counts,
        boundary_count.alias("boundary_count"),
        (boundary_count > 1).alias("crosses_service_boundary"),
        F.when(F.col("_strong"), "high").when(F.col("path_count") > 0, "medium").otherwise("low").alias("confidence"),
        blast_category(files_hit).alias("category"),
    )


def blast_category(file_count: Column) -> Column:
    return F.when(file_count <= 2, "narrow").when(file_count <= 8, "moderate").otherwise("wide")


def blast_members(members: DataFrame, files: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Functions, endpoints and models near each file's impact, one row each.

    ``is_callee`` marks functions that are reached only by a call out of the
    affected files.  What is near a root is found by bitmaps, range by range (``ranges``).
    """
    own = files.select("repo_key", F.col("path").alias("root"), F.col("path").alias("src_file"))
    if seeds is not None:
        roots = seeds.select("repo_key", text.posix(F.col("file")).alias("root")).distinct()
        own = own.join(roots, ["repo_key", "root"], "left_semi")
    affected = members.where(~F.col("is_test")).select("repo_key", "root", F.col("node").alias("src_file"))
    near = (
        edges.where(F.col("dst_type").isin("Function", "APIEndpoint", "DBModel"))
        .groupBy("repo_key", F.col("src_file").alias("node"), F.col("dst").alias("node_id"), F.col("dst_type").alias("node_type"))
        .agg(F.bool_and(F.col("edge_type") == "CALLS").alias("is_callee"))
    )
    # False comes before true and both before unknown, so the least of a node is what ``bool_and`` says.
    judged = F.coalesce(F.col("is_callee").cast("int"), F.lit(2)).alias("code")
    item = F.struct("node_id", "node_type").alias("label")
    near = cut(near.where("repo_key is not null and node is not null").select("repo_key", "node", item, judged))
    items = numbered(near.select("repo_key", "label").distinct(), ["repo_key", "label"], "item")
    ring = cut(own.unionByName(affected).where("root is not null").distinct())
    ids = numbered(near.select("repo_key", "node").distinct(), ["repo_key", "node"], "id")
    # Roots are numbers below zero: as a root, a file has nothing of its own.
    roots = numbered(ring.select("repo_key", "root").distinct(), ["repo_key", "root"], "id")
    roots = cut(roots.select("repo_key", "root", (-F.col("id") - 1).alias("node")))
    links = by_number(ring.withColumnRenamed("src_file", "via"), ids, "via").join(roots, ["repo_key", "root"]).drop("root")
    marks = cut(by_number(near, ids, "node").join(items, ["repo_key", "label"]).select("repo_key", "node", "item", "code"))
    items = items.select("item", F.lit(0).alias("code"), F.col("label.node_id").alias("label"), F.col("label.node_type").alias("detail"))
    rows = ranges.by_range(marks, links, items, 1, roots.withColumnRenamed("root", "name"))
    return ranges.least_codes(rows).select(
        "repo_key", F.col("root").alias("file"), F.col("label").alias("node_id"), F.col("detail").alias("node_type"),
        F.when(F.col("code") < 2, F.col("code") == 1).alias("is_callee"),
    )


def blast_radius(analysis: DataFrame, near: DataFrame) -> DataFrame:
    """The measures of ``analyze_change`` plus function, endpoint and model counts."""
    counts = near.groupBy("repo_key", "file").agg(
        F.count_if(F.col("node_type") == "Function").alias("function_count"),
        F.count_if(F.col("node_type") == "APIEndpoint").alias("api_count"),
        F.count_if(F.col("node_type") == "DBModel").alias("db_model_count"),
    )
    return analysis.join(counts, ["repo_key", "file"], "left").fillna(
        0, ["function_count", "api_count", "db_model_count"]
    )


def related_files(deps: DataFrame, files: DataFrame, limit: int = 6, python_only: bool = False, hops: int = 3) -> DataFrame:
    """The files most worth reading next to a file, in order of relevance.

    Dependencies, then direct dependents, tests and the rest of the impact; a file
    counts at its first place and the file itself never.  The impact is walked only
    for files that the first two groups leave open, which have fewer than ``limit``
    direct neighbours.
    """
    def ranked(df: DataFrame, group: int, key: Column) -> DataFrame:
        return df.select(
            "repo_key", F.col("root").alias("file"), F.col("node").alias("related"),
            F.struct(F.lit(group).alias("group"), key.alias("key")).alias("place"),
        )

    def first(places: DataFrame) -> DataFrame:
        best = (
            places.where(F.col("file") != F.col("related"))
            .groupBy("repo_key", "file", "related")
            .agg(F.min("place").alias("place"))
        )
        return top_per(best, ["repo_key", "file"], [F.col("place"), F.col("related")], limit, rank="position")

    by_name = F.array(F.lit(""), F.col("node"))
    by_walk = F.concat(F.array(F.lpad(F.col("depth").cast("string"), 4, "0")), F.col("path"))
    dependencies = deps.select("repo_key", F.col("consumer").alias("root"), F.col("dependency").alias("node"))
    dependents = deps.where(~text.is_python_test(F.col("consumer"))).select(
        "repo_key", F.col("dependency").alias("root"), F.col("consumer").alias("node")
    )
    near = cut(first(ranked(dependencies, 0, by_name).unionByName(ranked(dependents, 1, by_name))))
    full = near.where(F.col("position") == limit).select("repo_key", "file")
    open_files = cut(files.select("repo_key", F.col("path").alias("file")).join(full, ["repo_key", "file"], "left_anti"))
    members = impact_members(impact_paths(deps, open_files, hops))
    further = (
        ranked(members.where("is_test"), 2, by_name)
        .unionByName(ranked(members.where(~F.col("is_test") & (F.col("depth") > 1)), 3, by_walk))
        .unionByName(near.drop("position").join(open_files, ["repo_key", "file"], "left_semi"))
    )
    kept = first(further).unionByName(near.join(full, ["repo_key", "file"], "left_semi"))
    if python_only:
        kept = kept.where(F.col("related").endswith(".py"))
    return kept.select("repo_key", "file", "position", "related")


def context_summary(files: DataFrame, symbols: DataFrame, deps: DataFrame, hops: int = 3) -> DataFrame:
    """A short text block per file: symbols, dependencies, dependents, tests.

    The tests are the first of all within ``hops``; only the first ones of each file
    are passed on, so no row per pair of files is made.
    """
    def first(df: DataFrame, value: str, k: int, name: str) -> DataFrame:
        return bounded_list(df, ["repo_key", "file"], [F.col(value)], value, k, name)

    is_test = text.is_python_test(F.col("consumer"))
    functions = symbols.where(F.col("kind") == "Function").select("repo_key", "file", "qualified_name").distinct()
    dependencies = deps.select("repo_key", F.col("consumer").alias("file"), "dependency")
    dependents = deps.where(~is_test).select("repo_key", F.col("dependency").alias("file"), F.col("consumer").alias("node"))
    joined = files.select("repo_key", F.col("path").alias("file"))
    for part in (
        first(functions, "qualified_name", 20, "_symbols"),
        first(dependencies, "dependency", 8, "_dependencies"),
        first(dependents, "node", 8, "_dependents"),
        first(first_reached(deps, is_test, 8, hops), "node", 8, "_tests"),
    ):
        joined = joined.join(part, ["repo_key", "file"], "left")

    def line(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.array_join(column, ", "), F.lit("none")))

    return joined.select(
        "repo_key",
        "file",
        F.concat_ws(
            "\n",
            line("Defined symbols", "_symbols"),
            line("Direct dependencies", "_dependencies"),
            line("Direct dependents", "_dependents"),
            line("Related tests", "_tests"),
        ).alias("summary"),
    )


def _by_block(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row per block of ``LINE_BLOCK`` lines that a range of lines touches."""
    return df.withColumn("block", F.explode(F.sequence(F.floor(first / LINE_BLOCK), F.floor(last / LINE_BLOCK))))


def flow_entries(places: DataFrame, functions: DataFrame) -> DataFrame:
    """The functions whose span holds a place, (repo_key, file, line, symbol_id).

    Spans and lines meet by block of lines, so a file with many functions and many
    places is many small groups, and a line meets only the functions near it.  Places
    without a line, and those that no span holds, enter at all functions of the file.
    """
    key = ["repo_key", "file", "line"]
    spans = functions.where(F.col("line_start") <= F.col("line_end"))
    spans = _by_block(spans, F.col("line_start"), F.col("line_end"))
    at = places.where(F.col("line").isNotNull()).withColumn("block", F.floor(F.col("line") / LINE_BLOCK))
    inside = at.join(spans, ["repo_key", "file", "block"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    hit = cut(inside.select(*key, "symbol_id").distinct())
    # Null lines are equal to no hit, so they stay here.
    missed = places.join(hit.select(*key).distinct(), key, "left_anti")
    everywhere = missed.join(functions.select("repo_key", "file", "symbol_id"), ["repo_key", "file"]).select(*key, "symbol_id")
    return hit.unionByName(everywhere.distinct())


def trace_data_flow(
    requests: DataFrame, symbols: DataFrame, edges: DataFrame, deps: DataFrame
) -> DataFrame:
    """Who calls and what is called at a place, one row per (place, role, node).

    ``requests`` is (repo_key, file, line).  Functions whose span holds the line
    are the entries; all functions of the file when none does or the line is null.

    A place that enters at one function meets every caller and callee once, so only the
    rows of places with several entries are compared with each other.
    """
    places = cut(requests.select("repo_key", "file", "line").distinct())
    functions = symbols.where(F.col("kind") == "Function").select(
        "repo_key", "file", "symbol_id", "line_start", "line_end"
    )
    key = ["repo_key", "file", "line"]
    entries = cut(flow_entries(places, functions).withColumn("entries", F.count(F.lit(1)).over(Window.partitionBy(*key))))
    deps = cut(deps.select("repo_key", "consumer", "dependency").distinct())

    def role(df: DataFrame, name: str, node: str) -> DataFrame:
        return df.select(*key, F.lit(name).alias("role"), F.col(node).alias("node_id"))

    def met(name: str, links: DataFrame, node: str) -> DataFrame:
        found = entries.join(links.distinct(), ["repo_key", "symbol_id"])
        single, several = (role(found.where(places_of), name, node) for places_of in ("entries = 1", "entries > 1"))
        return single.unionByName(several.distinct())

    links = edges.where(F.col("edge_type").isin("CALLS", "QUERIES_DB"))
    calls = links.where(F.col("edge_type") == "CALLS").select("repo_key", F.col("dst").alias("symbol_id"), "src")
    uses = links.select("repo_key", F.col("src").alias("symbol_id"), "dst")
    dependents = deps.where(~text.is_python_test(F.col("consumer"))).withColumnRenamed("dependency", "file")
    return (
        role(entries, "entry", "symbol_id")
        .unionByName(met("caller", calls, "src"))
        .unionByName(met("callee", uses, "dst"))
        .unionByName(role(places.join(deps.withColumnRenamed("consumer", "file"), ["repo_key", "file"]), "file_dependency", "dependency"))
        .unionByName(role(places.join(dependents, ["repo_key", "file"]), "file_dependent", "consumer"))
    )
