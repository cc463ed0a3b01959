"""E: the memory of validated fixes - identity, upsert, embedding, similarity."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultatlas.functions import text
from faultatlas.plans.layout import cut, top_per

# Task code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def memory_repo_key(repo_key: Column) -> Column:
    """Repository scope of a memory row; no repository means ``global``."""
    return F.lower(text.strip(F.coalesce(F.nullif(repo_key, F.lit("")), F.lit("global"))))


def fix_id(repo_key: Column, bug_type: Column, affected_file: Column, root_cause: Column) -> Column:
    """Stable identity of a fix, blind to case, outer blanks and slash style."""
    fingerprint = F.concat_ws(
        "|",
        memory_repo_key(repo_key),
        F.lower(text.strip(bug_type)),
        F.lower(text.posix(affected_file)),
        F.lower(text.strip(root_cause)),
    )
    return F.concat(F.lit("fix:"), F.substring(F.sha2(fingerprint, 256), 1, 24))


def fix_records(fixed: DataFrame) -> DataFrame:
    """Memory rows of findings whose patch was published.

    ``fixed`` has the finding, its patch and its validation side by side.  The
    cause falls back to the title, the changed files to the finding's file.
    """
    cause = F.coalesce(F.nullif("root_cause", F.lit("")), F.col("title"))
    changed = F.when(F.size("files_changed") > 0, F.col("files_changed")).otherwise(F.array("file_path"))

    def shown(label: str, flag: str) -> Column:
        return F.concat(F.lit(f"{label}="), F.initcap(F.col(flag).cast("string")))

    summary = F.concat_ws(
        ";",
        shown("ast", "gate_1_ast_valid"),
        shown("tests", "gate_2_tests_passed"),
        shown("security", "gate_4_security_clean"),
        shown("security_scanner", "security_scanner_available"),
    )
    return fixed.select(
        fix_id(F.col("repo_key"), F.col("issue_class"), F.col("file_path"), cause).alias("fix_id"),
        memory_repo_key(F.col("repo_key")).alias("repo_key"),
        F.col("issue_class").alias("bug_type"),
        cause.alias("root_cause"),
        "fix_strategy",
        F.col("file_path").alias("affected_file"),
        F.col("total_score").alias("confidence_score"),
        "finding_id",
        F.array_join(changed, ",").alias("files_changed"),
        summary.alias("validation_summary"),
        "validated_at",
    )


def read_validation_summary(summary: Column) -> Column:
    """The ``name=value`` pairs of a summary as a map."""
    return F.str_to_map(summary, F.lit(";"), F.lit("="))


def upsert_fixes(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Memory with ``new`` applied; the latest evidence of an id replaces the old."""
    latest = top_per(new, ["fix_id"], [F.col("validated_at").desc(), F.col("finding_id").desc()])
    return memory.join(latest.select("fix_id"), "fix_id", "left_anti").unionByName(latest)


def memory_stats(memory: DataFrame) -> DataFrame:
    """Fixes stored per repository."""
    return memory.groupBy("repo_key").agg(F.count(F.lit(1)).alias("total_fixes_stored"))


def stored_text(bug_type: Column, root_cause: Column, fix_strategy: Column) -> Column:
    """The text a stored fix is embedded by."""
    return F.concat(
        F.lit("Issue type: "), bug_type, F.lit(". Root cause: "), root_cause,
        F.lit(". Validated fix: "), fix_strategy,
    )


def query_text(bug_type: Column, code_snippet: Column) -> Column:
    """The text a finding asks with."""
    return F.concat(bug_type, F.lit(": "), F.left(code_snippet, F.lit(500)))


def fit_embedder(texts: DataFrame, column: str = "text", dimensions: int = 256) -> PipelineModel:
    """Hashed, idf-weighted unit vectors; one pass over the texts."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=column, outputCol="_tokens", pattern="\\W+"),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimensions),
            IDF(inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol="_unit"),
        ]
    ).fit(texts)


def embed_text(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``embedding`` as a plain float array."""
    return (
        model.transform(texts)
        .withColumn("embedding", vector_to_array("_unit", "float32"))
        .drop("_tokens", "_counts", "_weighted", "_unit")
    )


def _near_pivots(pivots: np.ndarray, schema_columns: list[str]):
    """Task: unit vectors, each with its nearest pivot and the angle to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            raw = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            length = np.linalg.norm(raw, axis=1)
            kept = length > 0
            unit = raw[kept] / length[kept, None]
            cosines = np.clip(unit @ pivots.T, -1.0, 1.0)
            nearest = cosines.argmax(axis=1)
            yield pd.DataFrame(
                {
                    "repo_key": batch["repo_key"].to_numpy()[kept],
                    "id": batch["id"].to_numpy()[kept],
                    "embedding": list(unit),
                    "pivot": nearest,
                    "angle": np.arccos(cosines[np.arange(len(nearest)), nearest]),
                },
                columns=schema_columns,
            )

    return run


def _best_in_tiles(k: int, threshold: float, skip_same_id: bool):
    """Task: one matrix product per pair of tiles, at most ``k`` rows per query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = []
            for row in batch.itertuples(index=False):
                ids = np.array(row.ids, dtype=object)
                asked = np.array(row.query_ids, dtype=object)
                cosines = np.stack(row.query_vectors) @ np.stack(row.vectors).T
                if skip_same_id:
                    cosines[asked[:, None] == ids[None, :]] = -2.0
                for q, line in enumerate(cosines):
                    good = np.flatnonzero(line >= threshold)
                    best = sorted(good, key=lambda m: (-line[m], ids[m]))[:k]
                    hits.extend((row.repo_key, asked[q], ids[m], float(line[m])) for m in best)
            yield pd.DataFrame(hits, columns=["repo_key", "query_id", "fix_id", "similarity"])

    return run


def _with_direction(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has one: not null, no null or NaN in it, not zero.  The others match nothing."""
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col("embedding").isNotNull() & whole & F.exists("embedding", lambda x: x != 0.0))


def query_similar(
    memory: DataFrame,
    queries: DataFrame,
    k: int = 3,
    threshold: float = 0.85,
    tile_rows: int = 1024,
    pivots: int = 32,
    skip_same_id: bool = False,
) -> DataFrame:
    """E5: the ``k`` most similar fixes of the same repository, cosine >= threshold.

    Exact.  Vectors are packed into tiles around a few pivots; a pair of pivots
    whose angle less both radii exceeds the threshold angle cannot hold a match and
    is skipped.  The remaining tile pairs are matrix products that emit at most
    ``k`` rows per query, so no pair of vectors becomes a row.  A repository with
    a third of all rows is simply many tiles.  A small memory is one tile per
    repository.

    ``memory`` has (repo_key, fix_id, embedding), ``queries`` (repo_key, query_id,
    embedding).  At most ``pivots`` vectors pass through the driver.
    """
    stored = _with_direction(memory.select("repo_key", F.col("fix_id").alias("id"), F.col("embedding").cast("array<double>")))
    asked = _with_direction(queries.select("repo_key", F.col("query_id").alias("id"), F.col("embedding").cast("array<double>")))
    wanted = max(1, min(pivots, stored.count() // tile_rows))
    sample = stored.orderBy(F.xxhash64("repo_key", "id"), "repo_key", "id").limit(wanted).select("embedding").collect()
    vectors = [np.array(r[0]) for r in sample]
    result = "repo_key string, query_id string, fix_id string, similarity double"
    if not vectors:
        return memory.sparkSession.createDataFrame([], result)
    centre = np.stack([v / np.linalg.norm(v) for v in vectors])
    columns = ["repo_key", "id", "embedding", "pivot", "angle"]
    schema = "repo_key string, id string, embedding array<double>, pivot int, angle double"

    def tiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        near = cut(df.mapInPandas(_near_pivots(centre, columns), schema))
        groups = near.groupBy("repo_key", "pivot").agg(
            F.max("angle").alias("radius"),
            F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("slices"),
        )
        packed = (
            near.join(groups.drop("radius"), ["repo_key", "pivot"])
            .groupBy("repo_key", "pivot", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
            .agg(F.collect_list(F.struct("id", "embedding")).alias("members"))
            .select("repo_key", "pivot", "slice",
                    F.col("members.id").alias("ids"), F.col("members.embedding").alias("vectors"))
        )
        return groups, packed

    groups, packed = tiles(stored)
    asked_groups, asked_packed = tiles(asked)
    apart = F.element_at(
        F.element_at(F.lit(np.arccos(np.clip(centre @ centre.T, -1.0, 1.0)).tolist()), F.col("asked_pivot") + 1),
        F.col("pivot") + 1,
    )
    slack = 1e-9
    reachable = (
        asked_groups.select("repo_key", F.col("pivot").alias("asked_pivot"), F.col("radius").alias("asked_radius"))
        .join(groups, "repo_key")
        .where(apart - F.col("radius") - F.col("asked_radius") <= float(np.arccos(threshold)) + slack)
        .select("repo_key", "asked_pivot", "pivot", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    )
    pairs = (
        asked_packed.select(
            "repo_key", F.col("pivot").alias("asked_pivot"),
            F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"),
        )
        .join(reachable, ["repo_key", "asked_pivot"])
        .join(packed, ["repo_key", "pivot", "slice"])
        .select("repo_key", "query_ids", "query_vectors", "ids", "vectors")
    )
    hits = pairs.mapInPandas(_best_in_tiles(k, threshold, skip_same_id), result)
    return top_per(hits, ["repo_key", "query_id"], [F.col("similarity").desc(), F.col("fix_id")], k, rank="position")
