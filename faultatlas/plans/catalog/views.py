"""Inputs of the operators, made by Spark from the given tables.

``part`` rows become source files, pairs of parts in one order become imports.
Paths are pure functions of the part key, so no join is spent on naming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultatlas.operators.findings import finding_id
from faultatlas.plans.catalog.registry import table
from faultatlas.sources.files import load_files

REPO = "main"


def stem_of(key: Column) -> Column:
    return F.concat(
        F.when(key % 10 == 0, "test_").otherwise(""), F.lit("m"), F.lpad(key.cast("string"), 9, "0")
    )


def folder_of(key: Column) -> Column:
    return F.concat(F.lit("svc"), (F.floor(key / 7) % 8).cast("string"))


def path_of(key: Column) -> Column:
    return F.concat(folder_of(key), F.lit("/"), stem_of(key), F.lit(".py"))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): in every order the part of a line uses the part of the next line.

    Lines of one number go by part, so equal inputs give equal pairs.  The window holds
    the lines of one order; rows are two numbers, and a long order spills.
    """
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(lines).alias("dst")
    )
    return pairs.where("src <> dst").distinct()


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_key, file): the files asked about, per supplier the part shipped last."""
    last = F.max_by("l_partkey", F.struct(F.col("l_shipdate"), -F.col("l_partkey"))).alias("k")
    asked = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(last).select("k").distinct()
    return asked.select(F.lit(REPO).alias("repo_key"), path_of(F.col("k")).alias("file"))


def file_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File dependencies straight from the table, equal to what the text gives."""
    src, dst = F.col("src"), F.col("dst")
    return code_edges(spark, sf_dir).where(src % 97 != 5).select(
        F.lit(REPO).alias("repo_key"),
        path_of(src).alias("consumer"),
        path_of(dst).alias("dependency"),
        F.when((src + dst) % 3 != 0, "CALLS").when(src % 10 == 0, "TESTS").otherwise("IMPORTS").alias("evidence"),
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without content, for queries that need only names."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.lit(REPO).alias("repo_key"),
        path_of(key).alias("path"),
        F.lit("python").alias("language"),
        (F.col("p_size") * 100).cast("bigint").alias("size"),
        folder_of(key).alias("service_boundary"),
        (key % 10 == 0).alias("is_test"),
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_key, path, content): one Python source per part."""
    dst = F.col("dst")
    as_module = dst % 4 == 1
    edge_lines = code_edges(spark, sf_dir).select(
        "src",
        "dst",
        F.when(
            as_module,
            F.concat(F.lit("import "), folder_of(dst), F.lit("."), stem_of(dst), F.lit(" as a_"), stem_of(dst)),
        ).otherwise(
            F.concat(F.lit("from "), folder_of(dst), F.lit("."), stem_of(dst), F.lit(" import f_"), stem_of(dst))
        ).alias("text"),
        F.when(
            (F.col("src") + dst) % 3 != 0,
            F.concat(
                F.when(as_module, F.concat(F.lit("a_"), stem_of(dst), F.lit("."))).otherwise(""),
                F.lit("f_"), stem_of(dst), F.lit("(v)"),
            ),
        ).alias("call"),
    )
    per_file = edge_lines.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("dst", "text", "call"))).alias("uses")
    )
    k = F.col("p_partkey")
    stem = stem_of(k)

    def optional(condition: Column, *texts: Column) -> Column:
        return F.when(condition, F.array(*texts)).otherwise(F.expr("cast(array() as array<string>)"))

    uses = F.coalesce("uses", F.expr("cast(array() as array<struct<dst:bigint,text:string,call:string>>)"))
    calls = F.filter(F.transform(uses, lambda u: u["call"]), lambda c: c.isNotNull())
    content = F.concat(
        F.transform(uses, lambda u: u["text"]),
        optional(k % 3 == 0, F.lit("import os")),
        optional(k % 4 == 0, F.lit("import json.decoder as jd")),
        optional(k % 5 == 0, F.concat(F.lit('@app.get("/'), "p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit('")'))),
        F.array(F.concat(F.lit("def f_"), stem, F.lit("(v):"))),
        optional(F.col("p_size") % 2 == 0, F.lit("    if v > 1:"), F.lit("        v = v - 1")),
        optional(k % 6 == 0, F.concat(F.lit("    session.query("), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(")"))),
        optional(k % 7 == 0, F.concat(F.lit('    os.environ.get("K'), F.col("p_size").cast("string"), F.lit('")'))),
        F.array(F.concat(F.lit("    return "), F.array_join(F.concat(F.array(F.lit("v")), calls), " + "))),
        optional(
            k % 11 == 0,
            F.concat(F.lit("class C_"), stem, F.lit("(Base):")),
            F.lit("    def run(self, v):"),
            F.lit("        return self.step(v)"),
            F.lit("    def step(self, v):"),
            F.lit("        return v"),
        ),
        optional(k % 97 == 5, F.lit("def broken(:")),
    )
    return table(spark, sf_dir, "part").join(per_file, k == F.col("src"), "left").select(
        F.lit(REPO).alias("repo_key"),
        path_of(k).alias("path"),
        F.concat(F.array_join(content, "\n"), F.lit("\n")).alias("content"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources as a files table, spread like the splits of a stored one."""
    tasks = spark.sparkContext.defaultParallelism
    return load_files(code_corpus(spark, sf_dir).repartition(tasks, "path"))


def c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers ``inc/p<k>.h`` and sources ``src/p<k>.c`` with four kinds of include."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    source = F.concat(
        F.lit('#include <stdio.h>\n#include "../inc/p'), key, F.lit('.h"\n# include "inc/p'), size,
        F.lit('.h"\n  #include "p'), size, F.lit('.c"\nint x;\n'),
    )
    rows = F.array(
        F.struct(F.concat(F.lit("inc/p"), key, F.lit(".h")).alias("path"), F.lit("int y;\n").alias("content")),
        F.struct(F.concat(F.lit("src/p"), key, F.lit(".c")).alias("path"), source.alias("content")),
    )
    corpus = table(spark, sf_dir, "part").select(F.lit(REPO).alias("repo_key"), F.inline(rows))
    return load_files(corpus)


def sequence_number(*parts: Column) -> Column:
    """Repeatable 60-bit number of a row, without a global window."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per lineitem row, with paths as scanners report them."""
    key, order, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    path = path_of(key)
    spelled = (
        F.when(order % 5 == 0, F.replace(path, F.lit("/"), F.lit("\\")))
        .when(order % 3 == 0, F.concat(F.lit("./"), path))
        .when(order % 7 == 0, F.concat(F.lit("/work/checkout/"), path))
        .otherwise(path)
    )
    issue_class = (
        F.when((F.col("l_linestatus") == "O") & (supp % 4 == 0), "performance")
        .when(F.col("l_returnflag") == "A", "security_vulnerability")
        .when(F.col("l_returnflag") == "N", "functional_bug")
        .otherwise("code_quality")
    )
    levels = F.array(*[F.lit(s) for s in ("info", "low", "medium", "high", "critical", "weird")])
    title = F.concat(F.lit(" Issue "), (supp % 5).cast("string"), F.lit(" "))
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit(REPO).alias("repo_key"),
        issue_class.alias("issue_class"),
        F.get(levels, (F.col("l_quantity").cast("int") % 6)).alias("severity"),
        F.when(order % 2 == 1, F.upper(title)).otherwise(title).alias("title"),
        F.concat(F.lit("about part "), key.cast("string")).alias("description"),
        spelled.alias("file_path"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("line_number"),
        F.concat(F.lit("tool"), (supp % 4).cast("string")).alias("tool_source"),
        F.when(supp % 6 == 0, F.lit("known cause")).alias("root_cause"),
        F.when(supp % 10 == 0, F.lit("apply the fix")).alias("suggested_fix"),
        (supp % 4).cast("int").alias("source_priority"),
        sequence_number(order, F.col("l_linenumber"), key, supp, cents).alias("seq"),
    )
    return rows.withColumn(
        "finding_id",
        finding_id(*[F.col(c) for c in ("repo_key", "file_path")], F.col("seq"), F.col("issue_class"),
                   F.col("title"), F.col("tool_source")),
    )
