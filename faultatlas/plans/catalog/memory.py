"""Queries over the fix memory (E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultatlas import schemas
from faultatlas.operators import memory
from faultatlas.plans.catalog.registry import query, table
from faultatlas.plans.layout import checkpoint_folder, cut
from faultatlas.sources import tables

_ID_SQL = """concat('fix:', substr(sha256(concat_ws('|', lower(c_mktsegment), lower(o_orderstatus), concat('src/', CAST(o_custkey AS VARCHAR), '.py'), lower(o_orderpriority))), 1, 24))"""


def fixed(spark, sf_dir):
    """One published fix per order: segment is the repository, priority the cause."""
    key = F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").select(
        F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("repo_key"),
        F.col("o_orderstatus").alias("issue_class"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("root_cause"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("src\\"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("strategy "), key.cast("string")).alias("fix_strategy"),
        ((key % 100) / 100.0).alias("total_score"),
        F.lpad(key.cast("string"), 12, "0").alias("finding_id"),
        F.when(key % 3 == 0, F.array(F.lit("a.py"), F.lit("b.py"))).otherwise(F.expr("cast(array() as array<string>)")).alias("files_changed"),
        (key % 2 == 0).alias("gate_1_ast_valid"),
        (key % 3 == 0).alias("gate_2_tests_passed"),
        (key % 5 == 0).alias("gate_4_security_clean"),
        (key % 7 == 0).alias("security_scanner_available"),
        F.col("o_orderdate").alias("validated_at"),
    )


_RECORDS_SQL = f"""records AS (
  SELECT o_orderkey, o_orderdate, {_ID_SQL} AS fix_id, lower(c_mktsegment) AS repo_key, o_orderstatus AS bug_type, o_orderpriority AS root_cause,
    concat('src', chr(92), CAST(o_custkey AS VARCHAR), '.py') AS affected_file, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence_score,
    lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS finding_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'a.py,b.py' ELSE concat('src', chr(92), CAST(o_custkey AS VARCHAR), '.py') END AS files_changed,
    concat('ast=', CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END, ';tests=', CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END,
      ';security=', CASE WHEN o_orderkey % 5 = 0 THEN 'True' ELSE 'False' END, ';security_scanner=', CASE WHEN o_orderkey % 7 = 0 THEN 'True' ELSE 'False' END) AS validation_summary
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query("fix_records", f"WITH {_RECORDS_SQL} SELECT fix_id, repo_key, bug_type, root_cause, affected_file, confidence_score, finding_id, files_changed, validation_summary FROM records")
def fix_records(spark, sf_dir):
    return memory.fix_records(fixed(spark, sf_dir)).drop("fix_strategy", "validated_at")


def merged(spark, sf_dir):
    """The fixes before 1997 as memory, the later ones applied to it."""
    records = memory.fix_records(fixed(spark, sf_dir))
    year = F.year("validated_at")
    empty = records.limit(0)
    old = memory.upsert_fixes(empty, records.where(year < 1997))
    return memory.upsert_fixes(old, records.where(year >= 1997))


@query("memory_upsert", f"""WITH {_RECORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY year(o_orderdate) >= 1997 DESC, o_orderdate DESC, finding_id DESC) AS rn FROM records)
SELECT fix_id, repo_key, finding_id FROM r WHERE rn = 1""")
def memory_upsert(spark, sf_dir):
    return merged(spark, sf_dir).select("fix_id", "repo_key", "finding_id")


@query("memory_stats", f"WITH {_RECORDS_SQL} SELECT repo_key, count(DISTINCT fix_id) AS total_fixes_stored FROM records GROUP BY repo_key")
def memory_stats(spark, sf_dir):
    return memory.memory_stats(merged(spark, sf_dir))


@query("validation_summaries", f"""WITH {_RECORDS_SQL} SELECT finding_id, CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS tests FROM records""")
def validation_summaries(spark, sf_dir):
    records = memory.fix_records(fixed(spark, sf_dir))
    return records.select(
        "finding_id", F.try_element_at(memory.read_validation_summary(F.col("validation_summary")), F.lit("tests")).alias("tests")
    )


@query("similar_fixes", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT q.label, q.vec_id AS query_id, m.vec_id AS fix_id, list_cosine_similarity(q.e, m.e) AS similarity
  FROM v q JOIN v m ON q.label = m.label AND q.vec_id <> m.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, lpad(CAST(fix_id AS VARCHAR), 12, '0')) AS rn FROM p WHERE similarity >= 0.3)
SELECT CAST(label AS VARCHAR) AS repo_key, lpad(CAST(query_id AS VARCHAR), 12, '0') AS query_id, lpad(CAST(fix_id AS VARCHAR), 12, '0') AS fix_id,
  round(similarity, 5) AS similarity, rn AS position FROM r WHERE rn <= 3""")
def similar_fixes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("repo_key"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), "embedding"
    )
    # The given vectors hold no pair above the default threshold.
    hits = memory.query_similar(
        vectors.withColumnRenamed("id", "fix_id"), vectors.withColumnRenamed("id", "query_id"),
        threshold=0.3, skip_same_id=True,
    )
    return hits.select(
        "repo_key", "query_id", "fix_id", F.round("similarity", 5).alias("similarity"), F.col("position").cast("bigint").alias("position")
    )


@query("embedded_fixes", f"WITH {_RECORDS_SQL} SELECT repo_key, fix_id, 256 AS dimensions, true AS unit_length FROM records")
def embedded_fixes(spark, sf_dir):
    records = cut(memory.fix_records(fixed(spark, sf_dir)))
    texts = records.select(
        "repo_key", "fix_id",
        memory.stored_text(F.col("bug_type"), F.col("root_cause"), F.col("fix_strategy")).alias("text"),
    )
    embedded = memory.embed_text(texts, memory.fit_embedder(texts))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))
    return embedded.select(
        "repo_key", "fix_id", F.size("embedding").alias("dimensions"), (F.abs(length - 1) < 1e-3).alias("unit_length")
    )


@query("stored_memory", f"WITH {_RECORDS_SQL} SELECT fix_id, max(o_orderdate) AS validated_at FROM records GROUP BY fix_id")
def stored_memory(spark, sf_dir):
    """Two versions of the memory table; readers see the newer."""
    folder = f"{checkpoint_folder(spark)}/memory-{uuid.uuid4().hex}"
    records = memory.fix_records(fixed(spark, sf_dir))
    old = tables.read_versioned(spark, folder, schemas.MEMORY)
    tables.write_versioned(memory.upsert_fixes(old, records.where(F.year("validated_at") < 1997)), folder, 1)
    stored = tables.read_versioned(spark, folder, schemas.MEMORY)
    tables.write_versioned(memory.upsert_fixes(stored, records.where(F.year("validated_at") >= 1997)), folder, 2)
    return tables.read_versioned(spark, folder, schemas.MEMORY).select("fix_id", "validated_at")
