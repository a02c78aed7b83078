"""Queries over jobs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.listing import JOB_STATES, job_state
from ledgerspark.operators.ordered import find_hot
from ledgerspark.plans.registry import ORACLES, query
from ledgerspark.session import ensure_checkpoint_dir
from ledgerspark.sources.bridge import Ledger
from ledgerspark.streaming import jobs as J
from ledgerspark.streaming import ordered as O
from ledgerspark.streaming.assemble import rocks_state

_CODE = "CASE stage " + " ".join(f"WHEN '{n}' THEN {c}" for n, (c, _) in J.STAGES.items()) + " END"
_PROGRESS = "CASE stage " + " ".join(f"WHEN '{n}' THEN {p}" for n, (_, p) in J.STAGES.items()) + " END"


def scratch(led: Ledger) -> str:
    """A fresh folder below the session's checkpoint folder."""
    ensure_checkpoint_dir(led.spark)
    return f"{led.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def event_stream(led: Ledger) -> DataFrame:
    schema = led.table("events").schema
    raw = led.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(led.sf_dir)
    stage = (
        F.when(F.col("event_type") == "signup", "Queued")
        .when(F.col("event_type") == "view", "Extracting")
        .when(F.col("event_type") == "click", "DetectingBank")
        .when(F.col("event_type") == "purchase", "Completed")
        .otherwise("Failed")
    )
    return raw.select("event_id", F.col("user_id").alias("job_id"), "ts", stage.alias("stage"))


@query(
    "job_status",
    f"""SELECT job_id, stage, {_CODE} AS status, {_PROGRESS} AS progress, event_count FROM (SELECT job_id,
 arg_max(stage, ts) AS stage, count(*) AS event_count FROM job_events GROUP BY job_id)""",
)
def job_status(led: Ledger) -> DataFrame:
    """Runs as a stream over the event files and reads back the newest state of each job."""
    base = scratch(led)
    J.run_available(J.job_states(event_stream(led)), f"{base}/out", f"{base}/ckpt")
    out = J.latest_per_key(led.spark, f"{base}/out", "job_id")
    return out.select("job_id", "stage", "status", "progress", "event_count")


@query(
    "job_transitions",
    f"""SELECT event_id, job_id, status, previous, CASE WHEN previous IS NULL THEN status = 0 WHEN previous = 0
 THEN status IN (0, 1, 4) WHEN previous = 1 THEN status <> 0 WHEN previous = 3 THEN status = 0 ELSE false END AS is_allowed
 FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) previous FROM (SELECT *, {_CODE} status
 FROM job_events))""",
)
def job_transitions(led: Ledger) -> DataFrame:
    hot = find_hot(led.job_events, "job_id")
    return J.transitions(led.job_events, hot).select("event_id", "job_id", "status", "previous", "is_allowed")


@query("job_transitions_stream")
def job_transitions_stream(led: Ledger) -> DataFrame:
    """The same from a stream whose files hold events in any order and some of them twice; a last event far ahead closes it."""
    base = scratch(led)
    rows = led.job_events
    rows.repartition(3, F.xxhash64("event_id")).write.parquet(f"{base}/in")
    rows.where(F.xxhash64("event_id", F.lit(1)) % 7 == 0).coalesce(1).write.mode("append").parquet(f"{base}/in")
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    lateness = f"{int((span.b - span.a).total_seconds()) + 1} seconds"
    close = rows.limit(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("job_id"), (F.lit(span.b) + F.expr(f"interval {lateness}") * 3).alias("ts"), "stage"
    )
    stream = led.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    with rocks_state(led.spark):
        for more in (None, close):
            if more is not None:
                more.coalesce(1).write.mode("append").parquet(f"{base}/in")
            made = O.ordered_transitions(stream, lateness)
            start = made.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).foreachBatch(save).start()
            start.awaitTermination()
    out = led.spark.read.parquet(f"{base}/out")
    return out.where("job_id >= 0").select("event_id", "job_id", "status", "previous", "is_allowed")


ORACLES["job_transitions_stream"] = ORACLES["job_transitions"]

_STATES = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _, _ in JOB_STATES)
_DEFAULTS = " ".join(f"WHEN {c} THEN {p}" for c, _, _, p in JOB_STATES)


@query(
    "job_status_codes",
    f"""SELECT id, CASE processing_status {_STATES} ELSE 'Unknown' END AS status_name, CASE processing_status {_DEFAULTS}
 ELSE 0 END AS progress, processing_status = 5 AS requires_password FROM file_records""",
)
def job_status_codes(led: Ledger) -> DataFrame:
    state = job_state(F.col("processing_status"))
    names = ["status_name", "progress", "requires_password"]
    return led.file_records.select("id", *[state[n].alias(n) for n in names])


@query(
    "job_recovery",
    """SELECT id, CASE WHEN processing_status = 1 THEN 3 ELSE processing_status END AS processing_status,
 processing_status = 0 AS requeue, CASE WHEN processing_status = 1 THEN
 'Processing was interrupted by server restart. Please click Retry to reprocess.' END AS processing_error FROM file_records""",
)
def job_recovery(led: Ledger) -> DataFrame:
    return J.recover(led.file_records).select("id", "processing_status", "requeue", "processing_error")


@query("stream_skip_terminal", "SELECT id, processing_status FROM file_records WHERE processing_status NOT IN (2, 3, 4)")
def stream_skip_terminal(led: Ledger) -> DataFrame:
    return J.pending_files(led.file_records).select("id", "processing_status")


@query(
    "stream_summary",
    """SELECT source_file_id, count(*) AS total_transactions, count(*) FILTER (debit > 0) AS debit_count,
 count(*) FILTER (credit > 0 AND NOT coalesce(debit > 0, false)) AS credit_count,
 CAST(coalesce(sum(debit) FILTER (debit > 0), 0) AS DECIMAL(38,2)) AS total_debits,
 CAST(coalesce(sum(credit) FILTER (credit > 0 AND NOT coalesce(debit > 0, false)), 0) AS DECIMAL(38,2)) AS total_credits
 FROM ledger GROUP BY source_file_id""",
)
def stream_summary(led: Ledger) -> DataFrame:
    """The ledger is written as files, streamed, and the newest summary of each statement read back."""
    base = scratch(led)
    columns = led.ledger.select("source_file_id", "debit", "credit")
    columns.write.parquet(f"{base}/in")
    stream = led.spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    J.run_available(J.live_summary(stream), f"{base}/out", f"{base}/ckpt")
    return J.latest_per_key(led.spark, f"{base}/out", "source_file_id")


@query(
    "stream_ingest",
    """SELECT source_file_id AS file_id, row_no AS row_index, description, debit, credit, balance FROM clean_rows""",
)
def stream_ingest(led: Ledger) -> DataFrame:
    """Rendered statements are written as files, streamed, parsed per micro-batch and read back."""
    base = scratch(led)
    # One file per statement group, so no statement is cut by a micro-batch.
    led.words.repartition("file_id").write.parquet(f"{base}/in")
    stream = led.spark.readStream.schema(led.words.schema).parquet(f"{base}/in")
    J.ingest(stream, f"{base}/out", f"{base}/ckpt")
    out = J.ingested(led.spark, f"{base}/out")
    return out.select("file_id", "row_index", "description", "debit", "credit", "balance")
