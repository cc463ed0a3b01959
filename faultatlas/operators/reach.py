"""C3, C4, C7 without a row per pair: what a change reaches, as bitmaps.

Everything that can be reached has a number; a set of numbers is kept as a row of 64-bit
words per block of ``BLOCK`` numbers that it touches, and one more hop is an OR of the sets
that a file takes (``spread``).  Counts and pairs of whole reaches are walked range by range
(``ranges``): the links go to the numbers, and the sets stay in their task.  A file that
1,500 others use and that uses 1,500 others costs its links per range, never their product.

Numbers go by repository and name, so that what lies in one folder lies in few blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.plans.layout import cut

# Numbers per block: few words, so that sparse sets stay small and blocks are many tasks.
BLOCK = 512
# Files in one array of takers.
_SLICE = 512


def numbered(items: DataFrame, order: list[str], name: str) -> DataFrame:
    """Distinct ``items`` with a number ``name``: from 0, without gaps, in the ``order`` of their columns.

    Every range of the order counts its own rows; one row per range takes part in the sum before it.
    """
    ranged = items.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of such a number are the partition, the lower 33 the place in it.
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # Half the width where it is enough: arrays of numbers are what moves most.
    kind = "int" if ranged.count() < 1 << 31 else "bigint"
    return cut(ranged.withColumn("_part", part).join(starts, "_part").select(*items.columns, number.cast(kind).alias(name)))


def by_number(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with the numbers of ``ids`` (repo_key, node, id) instead of the names in ``column``."""
    named = ids.select("repo_key", F.col("node").alias(column), F.col("id").alias("_id"))
    return df.join(named, ["repo_key", column]).drop(column).withColumnRenamed("_id", column)


def placed(df: DataFrame, number: str) -> DataFrame:
    """``df`` with the block and the place of its column ``number`` instead."""
    return df.withColumns({"block": F.floor(F.col(number) / BLOCK), "place": F.pmod(F.col(number), F.lit(BLOCK))}).drop(number)


def _words() -> list[str]:
    return [f"w{i}" for i in range(-(-BLOCK // 64))]


def _merged(sets: DataFrame) -> DataFrame:
    """OR of all words of a (node, block)."""
    return sets.groupBy("repo_key", "node", "block").agg(*(F.bit_or(w).alias(w) for w in _words()))


def _sets(marks: DataFrame) -> DataFrame:
    """``repo_key, node, block`` and the words of marks (``repo_key, node, block, place``)."""
    bit, word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int")), F.floor(F.col("place") / 64)
    nothing = F.lit(0).cast("bigint")
    words = [F.when(word == i, bit).otherwise(nothing).alias(w) for i, w in enumerate(_words())]
    return _merged(marks.select("repo_key", "node", "block", *words))


def lists_of_ends(links: DataFrame, key: str, end: str) -> DataFrame:
    """``repo_key``, ``key``, ``ends``: the other ends of a node's links, in arrays of about ``_SLICE``."""
    many = links.groupBy("repo_key", key).agg(F.ceil(F.count(F.lit(1)) / _SLICE).alias("_slices")).where("_slices > 1")
    slice_of = F.coalesce(F.pmod(F.xxhash64(end), F.col("_slices")), F.lit(0))
    dealt = links.join(many, ["repo_key", key], "left").withColumn("_slice", slice_of)
    return dealt.groupBy("repo_key", key, "_slice").agg(F.collect_list(end).alias("ends")).drop("_slice")


def tasks_of(df: DataFrame) -> int:
    """Tasks for few bytes that are much work: a number given is one that Spark does not lower."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(own: DataFrame, steps: DataFrame, hops: int, passed: DataFrame | None = None, by_block: bool = True) -> DataFrame:
    """Sets of every node: its own marks and those of all nodes within ``hops`` steps.

    ``own`` is (repo_key, node, block, place), ``steps`` (repo_key, node, via): the
    node gets what ``via`` has.  ``passed`` are the marks that a node gives to others,
    all its own ones by default.  Returns ``repo_key, node, block`` and the words; ``node`` is
    a number, see ``numbered``.  Without ``by_block`` sets meet by node, for fewer blocks than tasks.
    """
    if hops < 1:
        return _sets(own)
    takers = cut(lists_of_ends(steps, "via", "node"))
    reached = _sets(own if passed is None else passed)
    for hop in range(1, hops + 1):
        given = reached.withColumnRenamed("node", "via").join(takers, ["repo_key", "via"], "left")
        # A node keeps what it has.
        itself = F.array("via")
        given = given.select("repo_key", "block", *_words(), F.coalesce(F.concat(itself, "ends"), itself).alias("takers"))
        if hop == hops and passed is not None:
            given = given.unionByName(_sets(own).withColumn("takers", F.array("node")).drop("node"))
        if by_block:
            # All of a block meets in one task, so the rows per dependency are never moved.
            given = given.repartition(tasks_of(given), "repo_key", "block")
        reached = _merged(given.select("repo_key", "block", *_words(), F.explode("takers").alias("node")))
    return reached


def numbers_in(sets: DataFrame, name: str) -> DataFrame:
    """``repo_key, node`` and the numbers in its sets, a row each."""
    words = F.explode(F.array(*(F.struct(F.lit(64 * i).alias("at"), F.col(w).alias("word")) for i, w in enumerate(_words()))))
    words = sets.select("repo_key", "node", "block", words.alias("x")).where("x.word <> 0")
    bits = words.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("shiftright(x.word, bit) & 1 = 1")
    return bits.select("repo_key", "node", (F.col("block") * BLOCK + F.col("x.at") + F.col("bit")).alias(name))


def numbered_links(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """``steps`` (repo_key, node, via) with the numbers of ``ids``."""
    return by_number(by_number(steps, ids, "node"), ids, "via")


def reach_pairs(steps: DataFrame, hops: int, roots: DataFrame | None = None) -> DataFrame:
    """``repo_key, root, node, depth``: what a root reaches within ``hops``, each node once, the root not.

    ``steps`` is (repo_key, node, via): from the node one comes to ``via``.  ``roots``
    (repo_key, root) limits the roots.
    """
    from faultatlas.operators import ranges

    steps = cut(steps.select("repo_key", "node", "via").where("repo_key is not null and node <> via").distinct())
    names = steps.select("repo_key", "node").unionByName(steps.select("repo_key", F.col("via").alias("node"))).distinct()
    ids = numbered(names, ["repo_key", "node"], "id")
    asked = ids if roots is None else ids.join(roots.select("repo_key", F.col("root").alias("node")), ["repo_key", "node"], "left_semi")
    named = asked.select("repo_key", F.col("node").alias("name"), F.col("id").alias("node"))
    marks = ids.select("repo_key", F.col("id").alias("node"), F.col("id").alias("item"), F.lit(0).alias("code"))
    items = ids.select(F.col("id").alias("item"), F.lit(0).alias("code"), F.col("node").alias("label"))
    return ranges.pairs(ranges.by_range(marks, numbered_links(steps, ids), items, hops, named), hops)


def _consumers(deps: DataFrame) -> DataFrame:
    return deps.select("repo_key", F.col("dependency").alias("node"), F.col("consumer").alias("via")).distinct()


def _strong(evidence: Column) -> Column:
    return evidence.isin("CALLS", "TESTS")


def impact_boundaries(deps: DataFrame, hops: int = 3) -> DataFrame:
    """C4: per file and boundary the files a change reaches there, the file itself not counted.

    ``repo_key, file, service_boundary, is_test, strength, n``: strength is 2 for
    files all of whose uses are calls or tests, 1 for some, 0 for none.
    """
    from faultatlas.operators import ranges

    groups = ["service_boundary", "is_test", "strength"]
    used = deps.groupBy("repo_key", F.col("consumer").alias("item")).agg(
        F.min(F.when(_strong(F.col("evidence")), 1).otherwise(0)).alias("_least"),
        F.max(F.when(_strong(F.col("evidence")), 1).otherwise(0)).alias("_most"),
    )
    others = deps.select("repo_key", F.col("dependency").alias("item"), F.lit(0).alias("_least"), F.lit(0).alias("_most"))
    # A file that uses nothing can be no member, only a root.
    ends = used.unionByName(others.join(used, ["repo_key", "item"], "left_anti").distinct()).where("repo_key is not null and item is not null")
    kind = F.struct(
        text.service_boundary(F.col("item")).alias("service_boundary"),
        text.is_python_test(F.col("item")).alias("is_test"), (F.col("_least") + F.col("_most")).alias("strength"),
    )
    files = numbered(ends.select("repo_key", F.col("item").alias("node"), kind.alias("group")), ["repo_key", "node"], "id")
    kinds = numbered(files.select("group").distinct(), ["group"], "kind")
    files = cut(files.join(kinds, "group").drop("group"))
    items = files.select(F.col("id").alias("item"), "kind")
    marks = files.select("repo_key", F.col("id").alias("node"), F.col("id").alias("item"), F.lit(1).alias("code"))
    rows = ranges.by_range(marks, numbered_links(_consumers(deps), files), items.select("item", F.col("kind").alias("code")), hops)
    found = ranges.counts(rows, hops)
    # Every set has the file itself; it is in its own group.
    itself = files.select("repo_key", F.col("node").alias("file"), F.col("id").alias("node"), F.col("kind").alias("_own"))
    return (
        found.join(itself, "node")
        .withColumn("n", F.col("n") - F.when(F.col("kind") == F.col("_own"), 1).otherwise(0))
        .where("n > 0")
        .join(kinds, "kind")
        .select("repo_key", "file", *(f"group.{g}" for g in groups), "n")
    )


def reach_summary(
    deps: DataFrame, files: DataFrame, hops: int = 3, seeds: DataFrame | None = None, boundaries: DataFrame | None = None
) -> DataFrame:
    """One row per file with the measures of ``analyze_change``, without its rows per pair.

    ``boundaries`` are the rows of ``impact_boundaries`` where they exist already.
    Confidence asks for the last step of the paths.  Where the groups do not settle it
    (no direct strong use, and files with strong and weak uses in reach), the paths of
    those files alone are walked.
    """
    from faultatlas.operators.impact import blast_category, impact_paths

    found = cut(impact_boundaries(deps, hops)) if boundaries is None else boundaries
    production = ~F.col("is_test")
    counted = found.groupBy("repo_key", "file").agg(
        F.coalesce(F.sum(F.when(production, F.col("n"))), F.lit(0)).alias("file_count"),
        F.coalesce(F.sum(F.when(F.col("is_test"), F.col("n"))), F.lit(0)).alias("related_tests"),
        F.sum("n").alias("path_count"),
        F.max("strength").alias("_strength"),
        F.count_distinct(F.when(production, F.col("service_boundary"))).alias("module_count"),
        F.bool_or(production & (F.col("service_boundary") == text.service_boundary(F.col("file")))).alias("_home_hit"),
    )
    inward = deps.groupBy("repo_key", F.col("dependency").alias("file")).agg(
        F.count_if(~text.is_python_test(F.col("consumer"))).alias("direct_dependents"),
        F.bool_or(_strong(F.col("evidence"))).alias("_strong"),
    )
    outward = deps.groupBy("repo_key", F.col("consumer").alias("file")).agg(F.count(F.lit(1)).alias("direct_dependencies"))
    known = files.select("repo_key", F.col("path").alias("file"), F.lit(True).alias("_known"))
    if seeds is None:
        wanted = known
    else:
        asked = seeds.select("repo_key", text.posix(F.col("file")).alias("file")).distinct()
        wanted = asked.join(known, ["repo_key", "file"], "left")
    joined = wanted
    for part in (counted, inward, outward):
        joined = joined.join(part, ["repo_key", "file"], "left")
    counts = ["file_count", "direct_dependents", "related_tests", "path_count", "module_count", "direct_dependencies"]
    joined = cut(joined.fillna(0, counts).fillna(False, ["_strong", "_home_hit"]))
    settled = F.when(F.col("_strong") | (F.col("_strength") == 2), True).when((F.col("path_count") == 0) | (F.col("_strength") == 0), False)
    joined = joined.withColumn("_settled", settled)
    open_roots = joined.where(F.col("_settled").isNull()).select("repo_key", "file")
    walked = (
        impact_paths(deps, open_roots, hops)
        .groupBy("repo_key", F.col("root").alias("file"))
        .agg(F.bool_or(_strong(F.col("evidence"))).alias("_walked"))
    )
    strong = F.coalesce("_settled", "_walked", F.lit(False))
    boundary_count = F.col("module_count") + F.when(F.col("_known") & ~F.col("_home_hit"), 1).otherwise(0)
    return joined.join(walked, ["repo_key", "file"], "left").select(
        "repo_key",
        "file",
        *counts,
        boundary_count.alias("boundary_count"),
        (boundary_count > 1).alias("crosses_service_boundary"),
        F.when(strong, "high").when(F.col("path_count") > 0, "medium").otherwise("low").alias("confidence"),
        blast_category(F.col("file_count")).alias("category"),
    )


_NEAR = ("Function", "APIEndpoint", "DBModel")


def blast_counts(deps: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``repo_key, file, function_count, api_count, db_model_count`` of each file's blast radius.

    Functions, endpoints and models that the file or a production file in its reach
    defines or uses, each counted once.
    """
    from faultatlas.operators import ranges

    near = edges.where(F.col("dst_type").isin(*_NEAR)).select("repo_key", "src_file", "dst", "dst_type").distinct()
    near = cut(near.where("repo_key is not null and src_file is not null and dst is not null"))
    named = numbered(near.groupBy("repo_key", "dst").agg(F.min("dst_type").alias("node_type")), ["repo_key", "dst"], "item")
    steps = cut(_consumers(deps))
    ends = (near.select("repo_key", F.col("src_file").alias("node")), steps.select("repo_key", "node"), steps.select("repo_key", F.col("via").alias("node")))
    ids = numbered(reduce(DataFrame.unionByName, ends).where("repo_key is not null and node is not null").distinct(), ["repo_key", "node"], "id")
    marks = near.select("repo_key", F.col("src_file").alias("node"), "dst").distinct().join(named, ["repo_key", "dst"])
    # A test hands nothing on.
    code = F.when(text.is_python_test(F.col("node")), 0).otherwise(1).alias("code")
    marks = cut(by_number(marks.select("repo_key", "node", "item", code), ids, "node"))
    # A kind is its place in the list.
    kinds = F.array(*map(F.lit, _NEAR))
    items = named.select("item", F.array_position(kinds, F.col("node_type")).alias("code"))
    found = ranges.counts(ranges.by_range(marks, numbered_links(steps, ids), items, hops), hops)
    found = found.withColumnRenamed("node", "id").join(ids, "id").withColumn("node_type", F.get(kinds, F.col("kind") - 1))

    def count(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("node_type") == kind, F.col("n"))), F.lit(0))

    names = ("function_count", "api_count", "db_model_count")
    return found.groupBy("repo_key", F.col("node").alias("file")).agg(*(count(k).alias(n) for k, n in zip(_NEAR, names, strict=True)))


def blast_report(deps: DataFrame, files: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """The measures of ``reach_summary`` with the counts of ``blast_counts``; files without any have zeros."""
    counts = ["function_count", "api_count", "db_model_count"]
    measured = reach_summary(deps, files, hops).join(blast_counts(deps, edges, hops), ["repo_key", "file"], "left")
    return measured.fillna(0, counts)


def first_reached(deps: DataFrame, wanted: Column, k: int, hops: int = 3) -> DataFrame:
    """``repo_key, file, position, node``: the ``k`` smallest names with ``wanted`` in each file's reach.

    The first of a union are among the first of its parts, so a hop moves one array of
    ``k + 1`` names per dependency (one more, since a file can meet itself on a cycle).
    ``wanted`` is a condition on the column ``consumer``.
    """
    key = ["repo_key", "file"]
    steps = deps.select("repo_key", F.col("dependency").alias("file"), F.col("consumer").alias("via"), wanted.alias("_wanted"))
    steps = steps.groupBy(*key, "via").agg(F.bool_or("_wanted").alias("_wanted"))
    steps = cut(steps)
    many = cut(steps.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / _SLICE).alias("_slices")).where("_slices > 1"))
    # The arrays of a file that many use meet in slices first.
    dealt = cut(steps.join(many, key, "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("via"), F.col("_slices")), F.lit(0))).drop("_slices"))

    def least(names: Column, more: int = 1) -> Column:
        return F.slice(F.array_sort(F.array_distinct(names)), 1, k + more)

    def merged(lists: DataFrame) -> DataFrame:
        of_slices = lists.groupBy(*key, "_slice").agg(least(F.flatten(F.collect_list("names"))).alias("names"))
        single, several = (of_slices.join(many.select(*key), key, how).drop("_slice") for how in ("left_anti", "left_semi"))
        return single.unionByName(several.groupBy(*key).agg(least(F.flatten(F.collect_list("names"))).alias("names")))

    direct = dealt.where("_wanted and via is not null").select(*key, "_slice", F.array("via").alias("names"))
    found = merged(direct)
    for _ in range(hops - 1):
        found = cut(found)
        further = dealt.join(found.withColumnRenamed("file", "via"), ["repo_key", "via"]).select(*key, "_slice", "names")
        found = merged(further.unionByName(found.withColumn("_slice", F.lit(0).cast("bigint"))))
    itself = F.filter("names", lambda name: name != F.col("file"))
    first = found.select(*key, F.posexplode(F.slice(itself, 1, k)).alias("position", "node"))
    return first.select(*key, (F.col("position") + 1).alias("position"), "node")
