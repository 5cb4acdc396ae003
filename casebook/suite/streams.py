"""Streaming counts, de-duplication and classification over the event and report files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import scoring
from ..session import shared_dir
from ..streaming import reports as stream
from . import roles
from .learned import by_examples_sql
from .registry import query
from .roles import table
from .texts import stop_words


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _events(spark, sf):
    return stream.read_reports(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_reports FROM events GROUP BY 1, 2")
def stream_report_counts(spark, sf):
    counts = stream.report_counts(_events(spark, sf), "ts", ["event_type"])
    rows = stream.to_files(counts, _fresh(spark, "counts"), _fresh(spark, "state"), "update")
    return stream.latest(rows, ["window_start", "event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_reports")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf):
    """One arrival per (user, type) in files; what has come in one batch is compared with no limit of time."""
    distinct = stream.distinct_reports(_events(spark, sf), "ts", ["user_id", "event_type"])
    return stream.to_files(distinct, _fresh(spark, "dedup"), _fresh(spark, "state")).select("user_id", "event_type")


def _arrive(spark, sf, folder, slices):
    """Files of events for each of the conditions, one after the other."""
    events = table(spark, sf, "events")
    for keep in slices:
        events.filter(keep).coalesce(1).write.mode("append").parquet(folder)
    return events.schema


def _in_order(spark, sf, n: int = 10) -> tuple[list, list]:
    """Conditions for ``n`` consecutive stretches of time, in two halves."""
    shares = [i / n for i in range(1, n)]
    cuts = table(spark, sf, "events").agg(F.percentile_approx("ts", shares, 10_000)).first()[0] or []
    ends = [None, *cuts, None]
    conditions = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        after = F.lit(True) if lo is None else F.col("ts") >= F.lit(lo)
        conditions.append(after if hi is None else after & (F.col("ts") < F.lit(hi)))
    return conditions[: n // 2], conditions[n // 2 :]


def _resumed(spark, sf, name, parts, plan, mode="append"):
    """Files arrive part by part, one a batch; each part is processed by a new query that goes on from the checkpoint."""
    folder, out, state = _fresh(spark, "arrivals"), _fresh(spark, name), _fresh(spark, "state")
    for part in parts:
        schema = _arrive(spark, sf, folder, part)
        rows = stream.to_files(plan(stream.read_reports(spark, folder, schema, files_per_batch=1)), out, state, mode)
    return rows


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_reports FROM events GROUP BY 1, 2")
def stream_counts_resumed(spark, sf):
    """Counts over ten batches and a restart: days that lie in two files are added up in the state store."""
    rows = _resumed(spark, sf, "counts", _in_order(spark, sf), lambda events: stream.report_counts(events, "ts", ["event_type"]), "update")
    return stream.latest(rows, ["window_start", "event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_reports")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup_resumed(spark, sf):
    """First arrivals over ten batches and a restart; no key is forgotten for a hundred years."""
    rows = _resumed(spark, sf, "dedup", _in_order(spark, sf), lambda events: stream.distinct_reports(events, "ts", ["user_id", "event_type"], "36500 days"))
    return rows.select("user_id", "event_type")


@query("""
WITH arrived AS (SELECT *, user_id % 2 <> 0 AS second FROM events),
closed AS (SELECT max(ts) - INTERVAL 2 DAY AS until FROM arrived WHERE NOT second)
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_reports
FROM arrived, closed WHERE NOT second OR date_trunc('day', ts) + INTERVAL 1 DAY > until GROUP BY 1, 2
""")
def stream_late_rows(spark, sf):
    """Events of odd users arrive after those of even users: days that had closed by then do not count them."""
    even = F.col("user_id") % 2 == 0
    rows = _resumed(spark, sf, "counts", ([even], [~even]), lambda events: stream.report_counts(events, "ts", ["event_type"]), "update")
    return stream.latest(rows, ["window_start", "event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_reports")


@query(by_examples_sql("(SELECT item_id, 'Report text: ' || trim(text) AS text FROM benchmark)"))
def stream_classify(spark, sf):
    """New reports classified as they arrive; the output is read back."""
    records = roles.records(spark, sf)
    fitted = scoring.fit_report_classifier(records, "doc_id", stop_words=list(stop_words()), with_models=False)
    arriving = stream.read_reports(spark, sf, table(spark, sf, "benchmark").schema, pattern="benchmark.parquet")
    out = _fresh(spark, "classified")
    stream.classify_stream(arriving, fitted, "item_id", scoring.new_report_text(F.lit(""), "text"), out, _fresh(spark, "state"))
    return spark.read.parquet(out).select("item_id", "predicted_risk", "predicted_problem", "predicted_sector")
