"""Loops over rows: refinement with a bound of passes, fallbacks, resumable branches, evolution.

Passes that only change columns are unrolled into one plan, so a row's loop costs no job.
Loops that need their results before they go on (branches, generations, tuning) run on the
driver and write each step's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.operators.runs import pruned
from docloom.sources.files import exists

Step = Callable[[DataFrame], DataFrame]


def run_nodes(rows: DataFrame, nodes: list[tuple[str, Step]]) -> DataFrame:
    """A workflow's nodes one after the other; each takes and gives rows."""
    for _, node in nodes:
        rows = rows.transform(node)
    return rows


def refine(rows: DataFrame, column: str, done: Callable[[Column], Column], change: Callable[[Column], Column], passes: int) -> DataFrame:
    """``rows`` with ``column`` changed until it is done, at most ``passes`` times, and the number of ``passes`` that took."""
    rows = rows.withColumn("passes", F.lit(0))
    for _ in range(passes):
        rows = rows.withColumn("_open", ~F.coalesce(done(F.col(column)), F.lit(False)))
        rows = rows.withColumns({column: F.when(F.col("_open"), change(F.col(column))).otherwise(F.col(column)), "passes": F.col("passes") + F.col("_open").cast("int")}).drop("_open")
    return rows.withColumn("done", F.coalesce(done(F.col(column)), F.lit(False)))


def apply_actions(rows: DataFrame, latex: str, actions: str) -> DataFrame:
    """``latex`` with the actions (structs of code and detail) of a pass: packages put in, commands defined, displays mended."""

    def act(text: Column, a: Column) -> Column:
        return F.when(a["code"] == "missing-package", M.inject_package(text, a["detail"])).when(a["code"] == "undefined-command", M.define_command(text, a["detail"])).when(a["code"] == "math-mode", M.normalise_displays(text)).otherwise(text)

    return rows.withColumn(latex, F.aggregate(actions, F.col(latex), act))


def improve_weak(rows: DataFrame, scores: str, target: float, gain: float, passes: int, weak_below: float) -> DataFrame:
    """An array of section scores raised by ``gain`` where weak, until their mean reaches the target, none is weak or the passes end."""
    mean = lambda: F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(scores), F.lit(1))
    rows = rows.withColumn("passes", F.lit(0))
    for _ in range(passes):
        goes = (F.round(mean(), 9) < target) & F.exists(scores, lambda x: x < weak_below)
        rows = rows.withColumn("_goes", goes)
        raised = F.transform(scores, lambda x: F.when(x < weak_below, F.least(F.lit(1.0), F.round(x + gain, 9))).otherwise(x))
        rows = rows.withColumns({scores: F.when(F.col("_goes"), raised).otherwise(F.col(scores)), "passes": F.col("passes") + F.col("_goes").cast("int")}).drop("_goes")
    return rows.withColumn("aggregate", F.round(mean(), 6))


def first_engine(outcomes: dict[str, Column], retry: Column) -> Column:
    """The first engine that succeeds, in order, or in reverse order on a retry; null if none does."""
    forward = F.coalesce(*(F.when(ok, name) for name, ok in outcomes.items()))
    backward = F.coalesce(*(F.when(ok, name) for name, ok in reversed(outcomes.items())))
    return F.when(retry, backward).otherwise(forward)


def run_branches(spark: SparkSession, branches: dict[str, Callable[[], DataFrame]], folder: str, enabled: Callable[[str], bool] = lambda _: True) -> dict[str, str]:
    """Branches one after the other, each written below ``folder``; those that a run before has finished are not run again.

    A branch that fails is noted and leaves the others running. Returns each one's status:
    completed, resumed, failed or skipped.
    """
    ledger = {}
    for name, branch in branches.items():
        path = f"{folder}/{name}"
        if not enabled(name):
            ledger[name] = "skipped"
        elif exists(spark, f"{path}/_SUCCESS"):
            ledger[name] = "resumed"
        else:
            try:
                branch().write.mode("overwrite").parquet(path)
                ledger[name] = "completed"
            except Exception:  # noqa: BLE001  (one branch's failure is a result)
                ledger[name] = "failed"
    return ledger


def evolve(versions: DataFrame, propose: Step, evaluate: Step, generations: int, limit: int, keep: Callable[[Column, Column], Column], write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Versions (key, version, parent, score) over generations: children proposed and scored, kept if ``keep(parent, child)``, the rest pruned by key.

    ``write(df, name)`` gives the rows back from a table, so each generation reads files.
    """
    for g in range(generations):
        children = evaluate(propose(versions))
        scores = versions.select("key", F.col("version").alias("parent"), F.col("score").alias("_parent"))
        kept = children.join(scores, ["key", "parent"]).where(keep(F.col("_parent"), F.col("score"))).select("key", "version", "parent", "score")
        versions = write(pruned(versions.select("key", "version", "parent", "score").unionByName(kept), "key", "score", "version", limit, str(g)), f"generation-{g}")
    return versions


def tune(measure: Callable[[dict], float], start: dict, propose: Callable[[dict, float], dict | None], target: float, iterations: int = 3) -> tuple[dict, float, list[float]]:
    """Parameters changed until a measure reaches the target, nothing is proposed or the iterations end; the best of them with its measure."""
    best, now, history = start, start, []
    top = float("-inf")
    for _ in range(iterations):
        value = measure(now)
        history.append(value)
        if value > top:
            best, top = now, value
        if value >= target:
            break
        now = propose(now, value)
        if now is None:
            break
    return best, top, history
