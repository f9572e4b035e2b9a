"""Queries: streaming forms over the events table, and sources and sinks round trips."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from spanalign.plans.registry import query
from spanalign.streaming import status


def _scratch(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spanalign-")
    return f"{base.rstrip('/')}/s-{uuid.uuid4().hex}"


def _events(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a table may be one file; a file source streams the files of a folder that match
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


@query("k_latest_status_stream", lambda d: "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def latest_status_stream(spark, sf):
    out = status.latest(_events(spark, sf), "user_id", ["ts", "event_id"], ["event_type"])
    return status.run_once(out, f"latest_{uuid.uuid4().hex}", _scratch(spark))


@query("k_windowed_counts_stream", lambda d: "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts_stream(spark, sf):
    out = status.windowed(_events(spark, sf), "ts", "1 hour", "2 hours", "event_type")
    return status.run_once(out, f"windows_{uuid.uuid4().hex}", _scratch(spark)).withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("k_pending", lambda d: "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_documents(spark, sf):
    return status.pending(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
