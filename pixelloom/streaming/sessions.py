"""Edit gestures over time: edits of one key close together are one. Batch by gaps, and the same as a stream.

The streaming form is this engine's own extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDIT_GAP_MS, SELECTION_GAP_MS = 500, 700


def coalesced(events: DataFrame, keys: list[str], time: str, gap_ms: int, order: str | None = None) -> DataFrame:
    """(keys, session, n_events, first_ts, last_ts): runs of events whose gaps do not exceed gap_ms."""
    w = Window.partitionBy(*keys).orderBy(time, *([order] if order else []))
    gap = F.expr(f"timestampdiff(MICROSECOND, _prev, {time}) > {gap_ms * 1000}")
    q = events.withColumn("_prev", F.lag(time).over(w)).withColumn("_new", F.when(F.col("_prev").isNull() | gap, 1).otherwise(0))
    q = q.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return q.groupBy(*keys, "session").agg(F.count("*").alias("n_events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def streaming_sessions(events: DataFrame, keys: list[str], time: str, gap_ms: int, late: str = "10 seconds") -> DataFrame:
    """The same over a stream: session windows with a watermark. A gap of exactly gap_ms parts sessions here."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, f"{gap_ms} milliseconds")).agg(F.count("*").alias("n_events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def latest_requests(requests: DataFrame, document: str, request: str) -> DataFrame:
    """Of each document the row with the highest request number: what is not stale."""
    return requests.groupBy(document).agg(F.max(request).alias(request), F.max_by(F.struct(*[c for c in requests.columns if c not in (document, request)]), request).alias("row")).select(document, request, "row.*")


def timeline(events: DataFrame, document: str, order: str, most: int) -> DataFrame:
    """The last ``most`` events of each document, with how many come after them."""
    w = Window.partitionBy(document).orderBy(F.desc(order))
    return events.withColumn("depth", F.row_number().over(w) - 1).filter(F.col("depth") < most)


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(idx, sig, old_idx): operations of a new plan matched with those of the old one by signature, first with first.

    old and new: (plan_id, idx, sig). An operation without a partner is new and has -1 as its old_idx.
    """
    w = Window.partitionBy("plan_id", "sig").orderBy("idx")
    a, b = old.withColumn("rn", F.row_number().over(w)), new.withColumn("rn", F.row_number().over(w))
    return b.join(a.select("plan_id", "sig", "rn", F.col("idx").alias("old_idx")), ["plan_id", "sig", "rn"], "left").select("plan_id", "idx", "sig", F.coalesce("old_idx", F.lit(-1)).alias("old_idx"))
