"""Queries over the event stream (L): the given events, read as a stream.

Each query drives its stream to the end of the input and reads back what the
sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultatlas import schemas
from faultatlas.operators import memory
from faultatlas.plans.catalog.memory import _RECORDS_SQL, fixed
from faultatlas.plans.catalog.registry import query
from faultatlas.plans.catalog.reports import run_events
from faultatlas.plans.layout import checkpoint_folder
from faultatlas.sources.tables import stream_events
from faultatlas.streaming import run_feed

_PHASES = ["signup", "error", "click", "view", "purchase"]


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    """Run events stored as several files, so a stream sees more than one batch."""
    folder = _folder(spark, "events")
    run_events(spark, sf_dir).repartition(4, "message").write.parquet(folder)
    return stream_events(spark, folder, files_per_trigger=2)


_METRICS_SQL = """SELECT CAST(user_id AS VARCHAR) AS job_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS findings,
  count(*) FILTER (WHERE event_type = 'purchase') AS pull_requests, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS elapsed_seconds FROM events GROUP BY user_id"""


@query("live_metrics", _METRICS_SQL)
def live_metrics(spark, sf_dir):
    metrics = run_feed.live_metrics(_events(spark, sf_dir), finding_event="error", change_event="purchase")
    folder = _folder(spark, "metrics")
    run_feed.append_batches(metrics, folder, mode="update").awaitTermination()
    schema = "job_id string, events bigint, findings bigint, pull_requests bigint, elapsed_seconds bigint"
    return run_feed.read_updates(spark, folder, ["job_id"], schema)


@query("sliced_metrics", _METRICS_SQL)
def sliced_metrics(spark, sf_dir):
    """Files may come in any order, so the watermark spans the whole input."""
    slices = run_feed.sliced_metrics(_events(spark, sf_dir), "3650 days", "1 day", finding_event="error", change_event="purchase")
    folder = _folder(spark, "slices")
    run_feed.append_batches(slices, folder, mode="update").awaitTermination()
    schema = (
        "job_id string, slice_start timestamp, events bigint, findings bigint, pull_requests bigint, "
        "first_ts timestamp, last_ts timestamp"
    )
    return run_feed.fold_slices(run_feed.read_updates(spark, folder, ["job_id", "slice_start"], schema))


@query("phase_progress", """SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(max(list_position(['signup', 'error', 'click', 'view', 'purchase'], event_type) - 1) AS BIGINT) AS phase_index FROM events GROUP BY user_id""")
def phase_progress(spark, sf_dir):
    progress = run_feed.phase_progress(_events(spark, sf_dir), _PHASES)
    folder = _folder(spark, "progress")
    run_feed.append_batches(progress, folder, mode="update").awaitTermination()
    return run_feed.read_updates(spark, folder, ["job_id"], "job_id string, phase_index int").select(
        "job_id", F.col("phase_index").cast("bigint").alias("phase_index")
    )


@query("latest_feed", """SELECT CAST(user_id AS VARCHAR) AS job_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""")
def latest_feed(spark, sf_dir):
    folder = _folder(spark, "feed")
    run_feed.write_latest_feed(_events(spark, sf_dir), folder).awaitTermination()
    return run_feed.read_latest_feed(spark, folder).select("job_id", F.col("message").cast("bigint").alias("event_id"))


@query("stream_memory", f"""WITH {_RECORDS_SQL} SELECT fix_id, max(o_orderdate) AS validated_at, max(repo_key) AS repo_key FROM records GROUP BY fix_id""")
def stream_memory(spark, sf_dir):
    source, folder = _folder(spark, "fixes"), _folder(spark, "memory")
    # Older evidence is stored first, so the stream meets it first.
    memory.fix_records(fixed(spark, sf_dir)).repartitionByRange(4, "validated_at").write.parquet(source)
    fixes = spark.readStream.schema(schemas.MEMORY).option("maxFilesPerTrigger", 4).parquet(source)
    run_feed.stream_upsert_fixes(fixes, folder).awaitTermination()
    return run_feed.read_memory(spark, folder).select("fix_id", "validated_at", "repo_key")
