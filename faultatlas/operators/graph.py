"""The code graph as ``nodes`` and ``edges`` tables.

Edges carry the files of both ends (``src_file``, ``dst_file``), which the
extractors know for free.  Collapsing the graph to file dependencies is then one
aggregation without any join to the nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.operators import python_source, resolution, text_patterns
from faultatlas.operators.findings import as_findings
from faultatlas.operators.reach import reach_pairs
from faultatlas.plans.layout import cut, top_per

# Order in which a later fact about the same (src, dst) replaces an earlier one.
_PASS = {
    "BELONGS_TO": 1,
    "DEFINES": 2,
    "IMPORTS_MODULE": 3,
    "IMPORTS": 4,
    "CALLS": 5,
    "TESTS": 6,
    "SERVES_API": 7,
    "QUERIES_DB": 8,
    "USES_CONFIG": 9,
}


@dataclass(frozen=True)
class CodeGraph:
    """Tables of one corpus; every member is a DataFrame keyed by repo_key."""

    files: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    unresolved_calls: DataFrame


def _edges(df: DataFrame, src: str, dst: str, edge_type: str, dst_type: str | Column,
           pass_name: str | None = None, resolved: bool | None = None, src_file: str = "file",
           dst_file: str | None = None, order: Column | None = None) -> DataFrame:
    def file_column(name: str | None) -> Column:
        return F.col(name) if name else F.lit(None).cast("string")

    return df.select(
        "repo_key",
        F.col(src).alias("src"),
        F.col(dst).alias("dst"),
        F.lit(edge_type).alias("edge_type"),
        F.lit(resolved).cast("boolean").alias("resolved"),
        F.lit(_PASS[pass_name or edge_type]).alias("pass_no"),
        file_column(src_file).alias("src_file"),
        file_column(dst_file).alias("dst_file"),
        (F.lit(dst_type) if isinstance(dst_type, str) else dst_type).alias("dst_type"),
        (F.lit(0) if order is None else order).alias("ord"),
    )


def service_boundaries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2: (boundary nodes, file -> boundary edges); files at the root have none."""
    below = files.where(F.contains("path", F.lit("/")))
    boundaries = below.select("repo_key", F.col("service_boundary").alias("name")).distinct()
    return boundaries, _edges(
        below, "path", "service_boundary", "BELONGS_TO", "ServiceBoundary", src_file="path"
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst); the fact of the latest pass wins."""
    fact = F.struct("edge_type", "resolved", "pass_no", "src_file", "dst_file", "dst_type")
    return (
        edges.groupBy("repo_key", "src", "dst")
        .agg(F.max_by(fact, F.struct("pass_no", "ord")).alias("fact"))
        .select("repo_key", "src", "dst", "fact.*")
    )


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id; the last definition wins."""
    return nodes.groupBy("repo_key", "node_id").agg(
        F.max_by(F.struct("node_type", "file", "attrs"), F.struct("pass_no", "ord")).alias("fact")
    ).select("repo_key", "node_id", "fact.*")


def mark_edge_confidence(edges: DataFrame) -> DataFrame:
    """Calls and queries are high, low when marked unresolved; others null."""
    judged = F.col("edge_type").isin("CALLS", "QUERIES_DB")
    return edges.withColumn(
        "confidence",
        F.when(judged & (F.col("resolved") == F.lit(False)), "low").when(judged, "high"),
    )


def _nodes(df: DataFrame, node_id: Column, node_type, file: Column, pass_no: int, order: Column, **attrs: Column) -> DataFrame:
    pairs = [part for name, value in attrs.items() for part in (F.lit(name), value.cast("string"))]
    everything = F.create_map(*pairs)
    return df.select(
        "repo_key",
        node_id.alias("node_id"),
        (F.lit(node_type) if isinstance(node_type, str) else node_type).alias("node_type"),
        file.cast("string").alias("file"),
        F.map_filter(everything, lambda _, v: v.isNotNull()).alias("attrs"),
        F.lit(pass_no).alias("pass_no"),
        order.alias("ord"),
    )


def build_graph(files: DataFrame, max_dropped: int | None = None) -> CodeGraph:
    """The whole graph of a corpus.

    The content is read twice, by the parse and by the patterns; both results are
    written, because several branches read them, and so are the edges, which every
    traversal reads.  ``files`` should be a stored table.
    """
    parsed = cut(python_source.parse_python(files))
    symbols = python_source.symbols(parsed)
    index = resolution.module_index(files)
    refs = resolution.import_refs(parsed)
    imports = resolution.resolve_imports(refs, index, max_dropped)
    calls, unresolved = resolution.resolve_calls(resolution.call_refs(parsed), symbols, index, max_dropped)
    modules = resolution.external_modules(parsed)
    facts = cut(text_patterns.scan_text(files))
    routes = text_patterns.extract_routes(facts)
    models = text_patterns.extract_db_refs(facts, symbols)
    settings = text_patterns.extract_config_refs(facts)
    boundaries, belongs = service_boundaries(files)

    includes = text_patterns.resolve_c_includes(facts, files)
    file_edges = resolution.retype_test_edges(
        _edges(imports, "file", "target", "IMPORTS", "File", resolved=True, dst_file="target").unionByName(
            _edges(includes, "file", "target", "IMPORTS", "File", resolved=True, dst_file="target")
        )
    ).withColumn("pass_no", F.when(F.col("edge_type") == "TESTS", _PASS["TESTS"]).otherwise(F.col("pass_no")))
    callee_type = F.when(F.col("target") == F.col("target_file"), "File").otherwise("Function")
    parts = [
        belongs,
        _edges(symbols, "file", "symbol_id", "DEFINES", F.col("kind"), dst_file="file", order=F.col("ord")),
        _edges(modules, "file", "module_id", "IMPORTS", "Module", "IMPORTS_MODULE"),
        file_edges,
        _edges(calls, "caller_id", "target", "CALLS", callee_type, resolved=True, dst_file="target_file"),
        _edges(routes, "file", "endpoint_id", "SERVES_API", "APIEndpoint"),
        _edges(models.where(F.col("function_id").isNotNull()), "function_id", "model_id", "QUERIES_DB", "DBModel"),
        _edges(settings, "file", "config_id", "USES_CONFIG", "ConfigVar"),
    ]
    edges = cut(mark_edge_confidence(merge_edges(reduce(DataFrame.unionByName, parts))))

    zero, nothing = F.lit(0), F.lit(None)
    node_parts = [
        _nodes(boundaries, F.col("name"), "ServiceBoundary", nothing, 1, zero, name=F.col("name")),
        _nodes(files, F.col("path"), "File", F.col("path"), 1, zero,
               language=F.col("language"), size=F.col("size"),
               service_boundary=F.col("service_boundary"), is_test=F.when(F.col("is_test"), True)),
        _nodes(symbols, F.col("symbol_id"), F.col("kind"), F.col("file"), 2, F.col("ord"),
               name=F.col("name"), qualified_name=F.col("qualified_name"),
               line_start=F.col("line_start"), line_end=F.col("line_end"),
               complexity=F.col("complexity")),
        _nodes(modules, F.col("module_id"), "Module", nothing, 3, zero,
               name=F.substring_index("module_id", ":", -1)),
        _nodes(routes, F.col("endpoint_id"), "APIEndpoint", nothing, 4, zero,
               route=F.col("route"), method=F.col("method")),
        _nodes(models, F.col("model_id"), "DBModel", nothing, 5, zero, table_name=F.col("model")),
        _nodes(settings.groupBy("repo_key", "config_id", "key").agg(F.max("file").alias("source_file")),
               F.col("config_id"), "ConfigVar", nothing, 6, zero,
               key=F.col("key"), source_file=F.col("source_file")),
    ]
    nodes = merge_nodes(reduce(DataFrame.unionByName, node_parts))
    return CodeGraph(files, parsed, symbols, nodes, edges, unresolved)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts per type, with totals (null type)."""
    def counts(df: DataFrame, what: str, column: str) -> DataFrame:
        return (
            df.rollup("repo_key", column)
            .agg(F.count(F.lit(1)).alias("n"), F.grouping("repo_key").alias("_all"))
            .where("_all = 0")
            .select("repo_key", F.lit(what).alias("element"), F.col(column).alias("type"), "n")
        )

    return counts(nodes, "node", "node_type").unionByName(counts(edges, "edge", "edge_type"))


def file_dependencies(edges: DataFrame) -> DataFrame:
    """(consumer, dependency, evidence); calls beat tests beat imports."""
    strength = F.when(F.col("edge_type") == "CALLS", 3).when(F.col("edge_type") == "TESTS", 2).otherwise(1)
    return (
        edges.where(
            F.col("edge_type").isin("IMPORTS", "TESTS", "CALLS")
            & F.col("src_file").isNotNull()
            & F.col("dst_file").isNotNull()
            & (F.col("src_file") != F.col("dst_file"))
        )
        .groupBy("repo_key", F.col("src_file").alias("consumer"), F.col("dst_file").alias("dependency"))
        .agg(F.max_by("edge_type", strength).alias("evidence"))
    )


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Nodes within ``hops`` undirected steps of each seed, with the distance.

    One hop is a join.  More are found for all seeds at once by bitmaps (``reach_pairs``).
    """
    both_ways = edges.select("repo_key", F.col("src").alias("near"), F.col("dst").alias("far")).unionByName(
        edges.select("repo_key", F.col("dst").alias("near"), F.col("src").alias("far"))
    ).where(F.col("near") != F.col("far"))
    asked = seeds.select("repo_key", F.col("node_id").alias("seed")).distinct()
    if hops < 1:
        return asked.select("repo_key", "seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).limit(0)
    if hops == 1:
        ring = asked.withColumnRenamed("seed", "near").join(both_ways.distinct(), ["repo_key", "near"])
        return ring.select("repo_key", F.col("near").alias("seed"), F.col("far").alias("node"), F.lit(1).alias("distance"))
    steps = both_ways.withColumnsRenamed({"near": "node", "far": "via"})
    found = reach_pairs(steps, hops, asked.withColumnRenamed("seed", "root"))
    return found.withColumnsRenamed({"root": "seed", "depth": "distance"})


def circular_dependencies(deps: DataFrame, max_len: int = 4, limit: int = 10) -> DataFrame:
    """The first ``limit`` simple import cycles per repository, shortest first.

    Up to four files.  Every cycle is found from its highest-degree file, so the
    two-step paths looked at number O(m * sqrt(m)), also around a hub.  Of the
    parallel middles of a four-file cycle only as many smallest ones are kept as
    can still be among the first ``limit``; the result is exact.  Longer cycles are
    looked for in repositories alone that have fewer than ``limit`` shorter ones.
    """
    if not 2 <= max_len <= 4:
        raise ValueError("max_len must be 2, 3 or 4")
    pairs = deps.select("repo_key", F.col("consumer").alias("a"), F.col("dependency").alias("b")).where("a <> b and repo_key is not null").distinct()
    two = cut(
        pairs.groupBy("repo_key", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        .agg(F.count(F.lit(1)).alias("ways"))
        .where("ways = 2")
        .select("repo_key", F.array("x", "y").alias("cycle"))
    )
    found, left = [two], pairs
    for length, longer in ((3, _cycles_of_three), (4, _cycles_of_four)):
        if length > max_len:
            break
        # The first cycles are the shortest: a repository that has enough is done.
        left = _open(left, reduce(DataFrame.unionByName, found), limit)
        if not left.limit(1).count():
            break
        left = cut(left) if length == 3 else left
        down, up, ranked = _by_anchor(left)
        found.append(cut(longer(down, up, ranked, limit)))
    cycles = reduce(DataFrame.unionByName, found)
    start = F.array_position("cycle", F.array_min("cycle")).cast("int")
    rotated = F.concat(
        F.slice("cycle", start, F.size("cycle") - start + 1), F.slice("cycle", F.lit(1), start - 1)
    )
    return top_per(
        cycles.select("repo_key", rotated.alias("cycle"), F.size("cycle").alias("length")),
        ["repo_key"],
        [F.col("length"), F.col("cycle")],
        limit,
        rank="position",
    )


def _open(deps: DataFrame, cycles: DataFrame, limit: int) -> DataFrame:
    """Rows of the repositories that have fewer than ``limit`` cycles so far."""
    enough = cycles.groupBy("repo_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    return deps.join(enough.select("repo_key"), "repo_key", "left_anti")


def _by_anchor(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges that leave their end of higher degree, edges that go to it, and both, with the ranks of the ends."""
    degree = (
        pairs.select("repo_key", F.explode(F.array("a", "b")).alias("v"))
        .groupBy("repo_key", "v")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    order = F.struct("degree", "v")
    # Only an edge whose tail is also a head and whose head is also a tail can be on a cycle.
    tails = pairs.select("repo_key", F.col("a").alias("b")).distinct()
    heads = pairs.select("repo_key", F.col("b").alias("a")).distinct()
    core = pairs.join(tails, ["repo_key", "b"], "left_semi").join(heads, ["repo_key", "a"], "left_semi")
    ranked = cut(
        core.join(degree.select("repo_key", F.col("v").alias("a"), order.alias("ra")), ["repo_key", "a"])
        .join(degree.select("repo_key", F.col("v").alias("b"), order.alias("rb")), ["repo_key", "b"])
    )
    return ranked.where("ra > rb"), ranked.where("ra < rb"), ranked


def _renamed(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select("repo_key", F.col("a").alias(src), F.col("b").alias(dst),
                     F.col("ra").alias("r" + src), F.col("rb").alias("r" + dst))


def _out_two(down: DataFrame, ranked: DataFrame) -> DataFrame:
    """x -> y -> z with x the anchor of both."""
    return (
        _renamed(down, "x", "y")
        .join(_renamed(ranked, "y", "z").drop("ry"), ["repo_key", "y"])
        .where("rx > rz")
    )


def _cycles_of_three(down: DataFrame, up: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    back = up.select("repo_key", F.col("a").alias("z"), F.col("b").alias("x"))
    three = _out_two(down, ranked).join(back, ["repo_key", "x", "z"])
    return three.select("repo_key", F.array("x", "y", "z").alias("cycle"))


def _cycles_of_four(down: DataFrame, up: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    back_two = (
        _renamed(up, "w", "x")
        .join(_renamed(ranked, "z", "w").drop("rw"), ["repo_key", "w"])
        .where("rx > rz")
    )
    enough = limit + 1
    out_kept = top_per(_out_two(down, ranked).select("repo_key", "x", "y", "z"), ["repo_key", "x", "z"], [F.col("y")], enough)
    back_kept = top_per(back_two.select("repo_key", "x", "w", "z"), ["repo_key", "x", "z"], [F.col("w")], enough)
    four = out_kept.join(back_kept, ["repo_key", "x", "z"]).where("y <> w")
    return four.select("repo_key", F.array("x", "y", "z", "w").alias("cycle"))


def cycle_findings(cycles: DataFrame) -> DataFrame:
    """Code-quality findings of the cycles."""
    return as_findings(
        cycles,
        issue_class=F.lit("code_quality"),
        severity=F.lit("medium"),
        title=F.lit("Circular dependency detected"),
        description=F.concat(F.lit("Files form a circular import chain: "), F.array_join("cycle", " -> ")),
        file_path=F.get("cycle", F.lit(0)),
        tool_source=F.lit("repo_mapper"),
        finding_id=F.substring(F.sha2(F.concat_ws("|", "repo_key", F.array_join("cycle", "|")), 256), 1, 16),
    )
