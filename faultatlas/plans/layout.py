"""How rows are laid out: lineage cuts, top rows per group, ranks, bounded lists.

These helpers hold the scale rules in one place:

* an iterative or shared plan is cut by writing a table to the shared folder the
  session names in ``spark.checkpoint.dir``, so a lost executor costs a re-read, a
  later step reads only its columns, and join sizes are known;
* the first rows of a group are picked by a rank filter, which Spark reduces to
  at most ``k`` rows per group *before* the shuffle, so a hot group stays small;
* a full ranking inside a group is built from range partitions plus offsets, so
  a group that holds a third of all rows is still ranked by many tasks;
* a list is only collected up to a stated length; the rest stays as rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Above this length Spark stops reducing rank filters before the shuffle
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
_PRE_SHUFFLE_RANK_LIMIT = 1000


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables and stream state.

    The session's own setting always wins.  Only a local session without one, as
    in tests, gets a fresh folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and go on from the files.

    Parquet rather than an RDD checkpoint: readers prune columns and push filters,
    and the optimizer sees true sizes.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches of the session have at most ``rows`` rows, for tasks whose rows are whole files.

    With Spark's default of 10,000 a worker holds as many files at a time as its
    partition has, so its memory grows with the input until then.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group; ``rank`` names an optional 1-based position."""
    name = rank or "_rank"
    if k > _PRE_SHUFFLE_RANK_LIMIT:
        # Too long for the pre-shuffle reduction: cut each of many salted slices first,
        # so the final window sees at most slices * k rows of a group.
        # The slice says nothing about the result, so any split of the rows will do.
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
        slice_window = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_slice_rank", F.row_number().over(slice_window))
            .where(F.col("_slice_rank") <= k)
            .drop("_salt", "_slice_rank")
        )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], rank: str = "position") -> DataFrame:
    """1-based position of every row in its group, with no task per group.

    ``order`` must be total inside a group.  Rows are range-partitioned on
    ``keys + order`` and cut, each (group, range) is numbered on its own, and the
    sizes of the earlier ranges of the group are added.  Only one row per (group,
    range) takes part in the offset step.
    """
    key_columns = [F.col(k) for k in keys]
    ranged = cut(df.repartitionByRange(*key_columns, *order).withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "_range")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    numbered = ranged.withColumn("_local", F.row_number().over(here.orderBy(*order)))
    return (
        numbered.join(offsets, [*keys, "_range"])
        .withColumn(rank, F.col("_before") + F.col("_local"))
        .drop("_range", "_local", "_before")
    )


def numbered_parts(
    ranked: DataFrame, keys: list[str], position: str, values: dict[str, Column], size: int = 1000
) -> DataFrame:
    """All rows of every group as arrays of up to ``size``: ``keys, part``, one array per value.

    ``position`` is the 1-based place of a row in its group (as from ``rank_within``);
    part 0 has the first rows.  Nothing is left out: a longer group has more parts.
    """
    part = F.floor((F.col(position) - 1) / size).cast("int")
    fields = [c.alias(name) for name, c in values.items()]
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_at"), *fields)))
    grouped = ranked.groupBy(*keys, part.alias("part")).agg(sorted_rows.alias("_rows"))
    return grouped.select(*keys, "part", *(F.col(f"_rows.{name}").alias(name) for name in values))


def bounded_list(
    df: DataFrame, keys: list[str], order: list[Column], value: str, k: int, name: str
) -> DataFrame:
    """Ordered array of the first ``k`` values of every group, one row per group.

    The rank filter runs before the collect, so the array never exceeds ``k``; the
    caller keeps the long form for whatever lies beyond.
    """
    first = top_per(df, keys, order, k, rank="_at")
    return first.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_value")))),
            lambda item: item["_value"],
        ).alias(name)
    )
