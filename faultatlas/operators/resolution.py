"""From parsed facts to file and symbol dependencies, as joins.

Resolution never depends on the referring file, only on the repository and the
dotted name.  So distinct names are resolved once and joined back: the number of
names is far below the number of references, and a name that a third of the
corpus imports costs one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.functions import text


def _dotted(parts: Column) -> Column:
    return F.array_join(parts, ".")


def module_index(files: DataFrame) -> DataFrame:
    """Every dotted suffix of a Python path -> the file that owns it.

    The smallest path wins a shared key.  ``min`` combines before the shuffle, so
    a key such as ``utils`` does not gather its owners in one task.
    """
    bare = F.regexp_replace("path", "(?<=[^/])\\.[^./]+$", "")
    parts = F.split(bare, "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: _dotted(F.slice(parts, i, n - i + 1)))
    package = F.when(
        (F.element_at(parts, -1) == "__init__") & (n > 1), F.array(_dotted(F.slice(parts, 1, n - 1)))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return (
        files.where(F.col("language") == "python")
        .select("repo_key", "path", F.explode(F.concat(suffixes, package)).alias("key"))
        .groupBy("repo_key", "key")
        .agg(F.min("path").alias("target"))
    )


def import_refs(parsed: DataFrame) -> DataFrame:
    """What each import may refer to, and the local name it binds.

    ``import a.b`` proposes ``a.b`` and binds ``a``; ``from m import x`` proposes
    ``m`` and ``m.x`` and binds ``x`` to ``m.x``.
    """
    module = F.col("module")
    candidates = (
        F.when(~F.col("is_from"), F.array(module))
        .when(module == "", F.array("dotted"))
        .otherwise(F.array(module, "dotted"))
    )
    return parsed.where(F.col("kind") == "import").select(
        "repo_key",
        "file",
        F.explode(candidates).alias("candidate"),
        F.col("asname").alias("alias"),
        "dotted",
        F.col("line_start").alias("line"),
        "ord",
    )


def external_modules(parsed: DataFrame) -> DataFrame:
    """(file, first component) of every import, with an id of its own space."""
    module = F.col("module")
    return (
        parsed.where((F.col("kind") == "import") & (module != ""))
        .select(
            "repo_key",
            "file",
            F.concat(F.lit("MOD:"), F.substring_index(module, ".", 1)).alias("module_id"),
        )
        .distinct()
    )


def resolve_names(names: DataFrame, index: DataFrame, max_dropped: int | None = None) -> DataFrame:
    """Distinct (repo_key, name) -> (target, dropped): fewest leading parts dropped.

    ``max_dropped`` limits how many leading parts a name may lose; None keeps the
    default of trying all, under which ``os.path`` finds any ``path.py``.
    """
    parts = F.split("name", "\\.")
    n = F.size(parts)
    last = n - 1 if max_dropped is None else F.least(n - 1, F.lit(max_dropped))
    tries = F.transform(
        F.sequence(F.lit(0), last),
        lambda d: F.struct(d.alias("dropped"), _dotted(F.slice(parts, d + 1, n - d)).alias("key")),
    )
    return (
        names.select("repo_key", "name")
        .distinct()
        .select("repo_key", "name", F.inline(tries))
        .join(index, ["repo_key", "key"])
        .groupBy("repo_key", "name")
        .agg(
            F.min_by("target", "dropped").alias("target"),
            F.min("dropped").alias("dropped"),
        )
    )


def resolve_imports(refs: DataFrame, index: DataFrame, max_dropped: int | None = None) -> DataFrame:
    """File -> file imports, no self edges."""
    wanted = refs.select("repo_key", "file", F.col("candidate").alias("name"))
    found = resolve_names(wanted, index, max_dropped)
    return (
        wanted.join(found, ["repo_key", "name"])
        .where(F.col("file") != F.col("target"))
        .groupBy("repo_key", "file", "target")
        .agg(F.min("dropped").alias("dropped"))
    )


def resolve_symbols(names: DataFrame, index: DataFrame, symbols: DataFrame, max_dropped: int | None = None) -> DataFrame:
    """Distinct (repo_key, name) -> symbol of the longest module prefix that exists.

    When that module has no such function, the module file itself is the target;
    the whole name as a module comes last.  All (prefix, dropped) pairs of a name
    meet the index in one join.
    """
    parts = F.split("name", "\\.")
    n = F.size(parts)

    def tries_of(cut_at: Column) -> Column:
        last = cut_at - 1 if max_dropped is None else F.least(cut_at - 1, F.lit(max_dropped))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda dropped: F.struct(
                # The whole name is tried after every proper prefix.
                F.struct(
                    F.when(cut_at == n, F.lit(0)).otherwise(cut_at).alias("prefix"),
                    (-dropped).alias("kept"),
                ).alias("strength"),
                _dotted(F.slice(parts, dropped + 1, cut_at - dropped)).alias("key"),
                _dotted(F.slice(parts, cut_at + 1, n - cut_at)).alias("symbol"),
            ),
        )

    best = (
        names.select("repo_key", "name")
        .distinct()
        .select("repo_key", "name", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), n), tries_of))))
        .join(index, ["repo_key", "key"])
        .groupBy("repo_key", "name")
        .agg(F.max_by(F.struct("target", "symbol"), "strength").alias("hit"))
        .select(
            "repo_key",
            "name",
            F.col("hit.target").alias("target_file"),
            F.concat("hit.target", F.lit("::"), "hit.symbol").alias("symbol_id"),
        )
    )
    defined = (
        symbols.where(F.col("kind") == "Function")
        .select("repo_key", "symbol_id")
        .distinct()
        .withColumn("is_symbol", F.lit(True))
    )
    return best.join(defined, ["repo_key", "symbol_id"], "left").select(
        "repo_key",
        "name",
        F.when(F.col("is_symbol"), F.col("symbol_id")).otherwise(F.col("target_file")).alias("target"),
        "target_file",
    )


def call_refs(parsed: DataFrame) -> DataFrame:
    """Call shapes per caller, settled as far as the file alone can."""
    return parsed.where(F.col("kind") == "call").select(
        "repo_key",
        "file",
        F.concat("file", F.lit("::"), "qualified_name").alias("caller_id"),
        "owner_class",
        "chain",
        "local_target",
        "dotted",
        F.col("line_start").alias("line"),
    )


def resolve_calls(
    calls: DataFrame, symbols: DataFrame, index: DataFrame, max_dropped: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(resolved call edges, unresolved calls).

    A name or a ``self``/``cls`` method of the same file is settled already;
    only imported names are joined.  Edges may repeat when a caller uses two
    spellings of one target.
    """
    columns = ["repo_key", "file", "caller_id", "target", "target_file"]
    local = calls.where(F.col("local_target").isNotNull()).select(
        "repo_key", "file", "caller_id",
        F.concat("file", F.lit("::"), "local_target").alias("target"), F.col("file").alias("target_file"),
    )
    outside = calls.where(F.col("local_target").isNull()).withColumnRenamed("dotted", "name")
    imported = outside.where(F.col("name").isNotNull())
    found = resolve_symbols(imported, index, symbols, max_dropped)
    joined = imported.join(found, ["repo_key", "name"], "left")
    edges = (
        local.unionByName(joined.where(F.col("target").isNotNull()).select(*columns))
        .where(F.col("target") != F.col("caller_id"))
    )
    open_calls = ["repo_key", "file", "caller_id", "chain"]
    unresolved = outside.where(F.col("name").isNull()).select(*open_calls).unionByName(
        joined.where(F.col("target").isNull()).select(*open_calls)
    )
    return edges, unresolved


def retype_test_edges(edges: DataFrame) -> DataFrame:
    """An edge from a Python test file to another file is a TESTS edge."""
    between_files = (F.col("src") == F.col("src_file")) & (F.col("dst") == F.col("dst_file"))
    tests = between_files & text.is_python_test(F.col("src_file"))
    return edges.withColumn(
        "edge_type", F.when(tests, "TESTS").otherwise(F.col("edge_type"))
    ).withColumn("resolved", F.when(tests, True).otherwise(F.col("resolved")))
