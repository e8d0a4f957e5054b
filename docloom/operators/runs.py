"""Event logs of runs: projection, ledgers, queues, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTES = 200
# Priorities of queue reasons, smaller first; others have the default.
PRIORITY = {"missing_snippet": 0, "validation_error": 0, "visual_regression": 1, "hallucination": 2, "low_quality": 3, "lint_warning": 4, "low_reward": 5}
DEFAULT_PRIORITY = 10


def log_rows(events: DataFrame, stage: Column, status: Column, notes: Column) -> DataFrame:
    """The log's projection: defaults filled in, notes cut to ``NOTES`` characters with an ellipsis."""
    n = F.coalesce(notes, F.lit(""))
    cut = F.when(F.char_length(n) > NOTES, F.concat(F.substring(n, 1, NOTES - 3), F.lit("..."))).otherwise(n)
    return events.select("event_id", F.coalesce(stage, F.lit("unknown")).alias("stage"), F.coalesce(status, F.lit("unknown")).alias("status"), cut.alias("notes"))


def cumulative(events: DataFrame) -> DataFrame:
    """Running totals by user in time order: the ledger without mutable state."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", "user_id", F.round(F.sum("value").over(w), 4).alias("total"), F.count("*").over(w).alias("n"))


def best_so_far(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("event_id", F.max("value").over(w).alias("best"))


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each user, oldest first numbers."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).select("user_id", "event_id", "back")


def moving_average(events: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average of each user's values in time order, the first value as seed.

    A user's values are folded in one array; it is as long as the user's history.
    """
    rows = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("h"))
    fold = F.aggregate(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), F.get("h", F.lit(0))["value"].cast("double"), lambda a, x: a * (1 - alpha) + x["value"] * alpha)
    return rows.select("user_id", F.round(fold, 6).alias("ema"))


def ledger(events: DataFrame) -> DataFrame:
    """Counts and averages by event type."""
    return events.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 0).alias("positive"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.countDistinct("user_id").alias("users"))


def queue(candidates: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates (chunk_id, page, reasons) by least priority, page, id."""
    rank = F.array_min(F.transform("reasons", lambda r: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), r), F.lit(DEFAULT_PRIORITY))))
    rows = candidates.withColumn("priority", F.coalesce(rank, F.lit(DEFAULT_PRIORITY)))
    return rows.orderBy("priority", F.coalesce("page", F.lit(0)), "chunk_id").limit(limit)


def global_totals(events: DataFrame) -> DataFrame:
    """Running totals over all events in time order, day by day: one window inside each day and one over the days."""
    rows = events.withColumn("_day", F.to_date("ts"))
    days = rows.groupBy("_day").agg(F.sum("value").alias("_v"), F.count("*").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_v").over(before), F.lit(0.0)).alias("_v"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_tv", F.sum("value").over(inside)).withColumn("_tn", F.count("*").over(inside))
    return rows.join(days, "_day").select("event_id", F.round(F.col("_v") + F.col("_tv"), 4).alias("total"), (F.col("_n") + F.col("_tn")).alias("n"))


def pruned(versions: DataFrame, key: str, score: str, ident: str, limit: int, seed: str = "") -> DataFrame:
    """Of each key the best ``limit`` - 1 rows and one of the rest, drawn by a seeded digest; all where there are no more than ``limit``."""
    w = Window.partitionBy(key)
    rows = versions.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(score), ident))).withColumn("_n", F.count("*").over(w))
    best = max(1, limit - 1)
    digest = F.md5(F.concat(F.lit(seed), F.col(ident).cast("string")).cast("binary"))
    tail = F.col("_rank") > best
    rows = rows.withColumn("_draw", F.row_number().over(w.partitionBy(key, tail).orderBy(digest)))
    return rows.where((F.col("_n") <= limit) | ~tail | (F.col("_draw") == 1)).drop("_rank", "_n", "_draw")


def run_states(events: DataFrame, failure: str) -> DataFrame:
    """Each user's events as steps of a run: IDLE at the first, RUNNING, FAILED from the first failure on, COMPLETED at the last."""
    w = Window.partitionBy("user_id")
    at, n = F.row_number().over(w.orderBy("ts", "event_id")), F.count("*").over(w)
    failed = F.max((F.col("event_type") == failure).cast("int")).over(w.orderBy("ts", "event_id")) == 1
    state = F.when(failed, "FAILED").when(at == n, "COMPLETED").when(at == 1, "IDLE").otherwise("RUNNING")
    return events.select("event_id", "user_id", state.alias("state"), F.round(100.0 * at / n, 4).alias("progress"))


def until_good(events: DataFrame, threshold: float) -> DataFrame:
    """Each user's events up to the first whose value reaches the threshold, with the best value so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done = F.max((F.col("value") >= threshold).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("_done", F.coalesce(done, F.lit(0))).withColumn("best", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_done = 0").select("event_id", "user_id", "best")


def branch_ledger(results: DataFrame) -> DataFrame:
    """How many results of each branch there are, and how many were completed, failed or skipped."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.groupBy("branch").agg(F.count("*").alias("total"), status("completed"), status("failed"), status("skipped"))
