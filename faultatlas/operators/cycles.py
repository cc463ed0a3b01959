"""Import cycles of any length, by strongly connected components.

Every file gets the smallest file that reaches it and the smallest one that it
reaches, along the edges that are left.  Files for which both are the same file are its
component.  All others go on: files of one component agree in both labels, so edges
between files that differ are on no cycle and are dropped.  Labels follow the labels of
labels, so a ring of ``n`` files takes about ``log n`` rounds, and a round is one
aggregation by file with partial sums, whatever hubs there are.  On the way files are
numbers in the order of their names, all repositories in one count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultatlas.operators.graph import _open, circular_dependencies, cycle_findings
from faultatlas.plans.layout import cut, rank_within, top_per

_FILE = ["repo_key", "file"]


def _on_both_sides(edges: DataFrame) -> DataFrame:
    """Edges that can be on a cycle: their begin is an end of some edge, their end a begin."""
    ends = edges.select(F.col("dst").alias("src")).distinct()
    begins = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(ends, "src", "left_semi").join(begins, "dst", "left_semi")


def _labels(edges: DataFrame) -> DataFrame:
    """``file, before, after``: the smallest files that reach a file and that it reaches, itself included."""
    key = ["file", "forward"]
    steps = cut(
        edges.select(F.col("src").alias("via"), F.col("dst").alias("file"), F.lit(True).alias("forward")).unionByName(
            edges.select(F.col("dst").alias("via"), F.col("src").alias("file"), F.lit(False).alias("forward"))
        )
    )
    files = steps.select(*key).distinct()
    labels = cut(files.withColumn("label", F.col("file")))
    while True:
        of_via = labels.select(F.col("file").alias("via"), "forward", "label")
        given = steps.join(of_via, ["via", "forward"]).select(*key, "label")
        # What reaches the file that reaches a file, reaches the file too.
        followed = (
            labels.where("label <> file").select(*key, F.col("label").alias("via"))
            .join(of_via, ["via", "forward"]).select(*key, "label")
        )
        own = labels.select(*key, "label", F.col("label").alias("was"))
        found = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [own, given, followed])
        labels = cut(
            found.groupBy(*key).agg(F.min("label").alias("label"), F.min("was").alias("was"))
            .select(*key, "label", (F.col("label") < F.col("was")).alias("moved"))
        )
        if not labels.where("moved").limit(1).count():
            break
        labels = labels.drop("moved")
    return labels.groupBy("file").agg(
        F.min(F.when(F.col("forward"), F.col("label"))).alias("before"),
        F.min(F.when(~F.col("forward"), F.col("label"))).alias("after"),
    )


def cycle_components(deps: DataFrame) -> DataFrame:
    """``repo_key, component, file``: files that reach each other, one row each.

    ``component`` is the smallest file.  Files on no cycle have no row.
    """
    named = cut(
        deps.select("repo_key", F.col("consumer").alias("src"), F.col("dependency").alias("dst"))
        .where("src <> dst and repo_key is not null").distinct()
    )
    names = named.select("repo_key", F.col("src").alias("file")).unionByName(named.select("repo_key", F.col("dst").alias("file")))
    numbers = cut(rank_within(cut(names.distinct()), [], [F.col("repo_key"), F.col("file")], rank="id"))
    ends = [numbers.select("repo_key", F.col("file").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst")]
    left = named.join(ends[0], ["repo_key", "src"]).join(ends[1], ["repo_key", "dst"])
    left = cut(left.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    found = []
    remaining = left.count()
    while remaining:
        # Chains into and out of cycles go before labels are spent on them.
        trimmed = cut(_on_both_sides(left))
        still = trimmed.count()
        if still < remaining:
            left, remaining = trimmed, still
            continue
        labels = cut(_labels(left))
        done = labels.where("before = after").select(F.col("before").alias("component"), "file")
        found.append(done)
        undone = labels.where("before <> after")
        ends = [undone.select(F.col("file").alias(c), "before", "after") for c in ("src", "dst")]
        left = cut(left.join(ends[0], "src").join(ends[1], ["dst", "before", "after"]).select("src", "dst"))
        remaining = left.count()
    if not found:
        return deps.select("repo_key", F.col("consumer").alias("component"), F.col("consumer").alias("file")).limit(0)
    members = reduce(DataFrame.unionByName, found)
    more = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = members.join(more, "component", "left_semi").withColumnRenamed("file", "id")
    shown = members.join(numbers, "id").join(
        numbers.select(F.col("id").alias("component"), F.col("file").alias("_component")), "component"
    )
    return shown.select("repo_key", F.col("_component").alias("component"), "file")


def witness_cycles(deps: DataFrame, members: DataFrame, longest: int = 64) -> DataFrame:
    """``repo_key, component, cycle, length``: a shortest cycle through the smallest file of each component.

    The search goes from that file along the edges of its component, all components at
    once, and keeps the least path to each file.  Components whose smallest file is on
    no cycle of up to ``longest`` files have no row here; their members are all known.
    """
    key = ["repo_key", "component"]
    inside = deps.select("repo_key", F.col("consumer").alias("file"), F.col("dependency").alias("to")).distinct()
    inside = inside.join(members, _FILE).join(
        members.select("repo_key", "component", F.col("file").alias("to")), ["repo_key", "component", "to"]
    )
    steps = cut(inside.select(*key, "file", "to"))
    reached = members.where("file = component").select(*key, "file", F.array("file").alias("path"))
    closed = None
    for length in range(1, longest + 1):
        newest = reached.where(F.size("path") == length)
        grown = cut(newest.join(steps, [*key, "file"]).select(*key, F.col("to").alias("file"), "path"))
        if not grown.limit(1).count():
            break
        back = grown.where("file = component").groupBy(*key).agg(F.min("path").alias("cycle"))
        closed = back if closed is None else closed.unionByName(back)
        further = grown.where("file <> component").select(*key, "file", F.concat("path", F.array("file")).alias("path"))
        open_ones = reached.unionByName(further).join(back.select(*key), key, "left_anti")
        reached = cut(open_ones.groupBy(*key, "file").agg(F.min(F.struct(F.size("path"), "path")).alias("best")).select(*key, "file", "best.path"))
    if closed is None:
        closed = reached.select(*key, F.col("path").alias("cycle")).limit(0)
    return closed.select(*key, "cycle", F.size("cycle").alias("length"))


def dependency_cycles(deps: DataFrame, limit: int = 10, longest: int = 64) -> DataFrame:
    """The first ``limit`` cycles per repository, shortest first: ``repo_key, position, cycle, length``.

    All cycles of up to four files, and of components without a shorter one the
    shortest cycle through their smallest file.  Those are behind all short ones, so a
    repository with ``limit`` short cycles is not searched for them.
    """
    deps = cut(deps.select("repo_key", "consumer", "dependency").distinct())
    short = cut(circular_dependencies(deps, 4, limit))
    deps = _open(deps.where("repo_key is not null"), short, limit)
    if not deps.limit(1).count():
        return short
    deps = cut(deps)
    members = cut(cycle_components(deps))
    # A component with a short cycle has at least that; the search is for the others.
    with_short = short.select("repo_key", F.explode("cycle").alias("file")).distinct().join(members, _FILE)
    others = members.join(with_short.select("repo_key", "component").distinct(), ["repo_key", "component"], "left_anti")
    witnesses = witness_cycles(deps, cut(others), longest).where("length > 4")
    everything = short.select("repo_key", "cycle", "length").unionByName(witnesses.select("repo_key", "cycle", "length"))
    return top_per(everything, ["repo_key"], [F.col("length"), F.col("cycle")], limit, rank="position")


def findings_of_cycles(deps: DataFrame, limit: int = 10) -> DataFrame:
    """Code-quality findings of the first cycles of any length."""
    return cycle_findings(dependency_cycles(deps, limit))
