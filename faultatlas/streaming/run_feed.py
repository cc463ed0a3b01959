"""L: run events as a stream - metrics, progress, feed and memory kept up to date.

Each query writes through ``foreachBatch`` to files below the shared checkpoint
folder; a batch that is tried again overwrites its own output, so results hold
when executors or the driver are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultatlas import schemas
from faultatlas.functions.vocabulary import phase_index
from faultatlas.plans.layout import top_per
from faultatlas.sources.tables import latest_version, read_versioned, write_versioned

# Event types that report a fixable finding and a proposed change.
FINDING_EVENT, CHANGE_EVENT = "finding_discovered", "pr_created"


def _run_counts(finding_event: str, change_event: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == finding_event).alias("findings"),
        F.count_if(F.col("event_type") == change_event).alias("pull_requests"),
    ]


def live_metrics(
    events: DataFrame, finding_event: str = FINDING_EVENT, change_event: str = CHANGE_EVENT
) -> DataFrame:
    """L2: per job the counts of events, findings and changes, and the seconds so far.

    The state is one small row per job and stays; see ``sliced_metrics`` for a feed
    without end.
    """
    elapsed = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("elapsed_seconds")
    return events.groupBy("job_id").agg(*_run_counts(finding_event, change_event), elapsed)


def sliced_metrics(
    events: DataFrame, watermark: str, time_slice: str = "1 hour",
    finding_event: str = FINDING_EVENT, change_event: str = CHANGE_EVENT,
) -> DataFrame:
    """L2 with bounded state: the same counts per job and slice of time.

    A slice leaves the state once the watermark has passed it; events that come
    later still are not counted.  ``fold_slices`` adds the slices of a job.
    """
    return (
        events.withWatermark("ts", watermark)
        .groupBy("job_id", F.window("ts", time_slice).alias("slice"))
        .agg(*_run_counts(finding_event, change_event), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("job_id", F.col("slice.start").alias("slice_start"), "events", "findings", "pull_requests", "first_ts", "last_ts")
    )


def fold_slices(slices: DataFrame) -> DataFrame:
    """L2: the metrics of each job from its stored slices."""
    return slices.groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in ("events", "findings", "pull_requests")],
        F.timestamp_diff("SECOND", F.min("first_ts"), F.max("last_ts")).alias("elapsed_seconds"),
    )


def phase_progress(events: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """L3: the furthest phase a job has reached; it never steps back."""
    return events.groupBy("job_id").agg(F.max(phase_index(F.col("phase"), phases)).alias("phase_index"))


def append_batches(rows: DataFrame, folder: str, mode: str = "append", trigger: dict | None = None, reduce=None) -> StreamingQuery:
    """Store every micro-batch in a folder of its own, reduced first if asked.

    A batch costs what it brings, not what is stored already; readers merge.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        kept = reduce(batch) if reduce else batch
        kept.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch_id}")

    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(store)
        .start()
    )


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest snapshot and the batches after it, with their ``batch`` number."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/batches")
    done = latest_version(spark, f"{folder}/snapshots")
    if done is None:
        return rows
    snapshot = read_versioned(spark, f"{folder}/snapshots", schema).withColumn("batch", F.lit(done).cast("bigint"))
    return snapshot.unionByName(rows.where(F.col("batch") > done))


def compact(spark: SparkSession, folder: str, schema: str, merged: DataFrame) -> None:
    """Store ``merged`` as the snapshot of all batches so far, run between streams."""
    last = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/batches").agg(F.max("batch")).first()[0]
    if last is not None:
        write_versioned(merged, f"{folder}/snapshots", last)


def read_updates(spark: SparkSession, folder: str, keys: list[str], schema: str) -> DataFrame:
    """The newest row per key of a running aggregate stored in update mode."""
    return top_per(read_batches(spark, folder, schema), keys, [F.col("batch").desc()]).drop("batch")


def _newest(events: DataFrame, k: int) -> DataFrame:
    return top_per(events, ["job_id"], [F.col("ts").desc(), F.col("message").desc()], k)


def write_latest_feed(events: DataFrame, folder: str, k: int = 50, trigger: dict | None = None) -> StreamingQuery:
    """L4: store at most the newest ``k`` events per job of every batch."""
    return append_batches(events, folder, trigger=trigger, reduce=lambda batch: _newest(batch, k))


def read_latest_feed(spark: SparkSession, folder: str, k: int = 50) -> DataFrame:
    """L4: the newest ``k`` events per job."""
    return _newest(read_batches(spark, folder, schemas.EVENTS).drop("batch"), k)


def stream_upsert_fixes(fixes: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply fix records to the memory as they land; one row per id and batch."""
    return append_batches(fixes, folder, trigger=trigger, reduce=_latest_evidence)


def _latest_evidence(fixes: DataFrame) -> DataFrame:
    return top_per(fixes, ["fix_id"], [F.col("validated_at").desc(), F.col("finding_id").desc()])


def read_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The memory as of the last batch; later batches replace earlier ones."""
    return top_per(read_batches(spark, folder, schemas.MEMORY), ["fix_id"], [F.col("batch").desc()]).drop("batch")
