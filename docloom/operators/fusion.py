"""Candidates of a chunk: scores, rankings, fusions and votes; validation roll-ups of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of a candidate's scores, and what an unknown branch counts.
WEIGHTS = {"math": 0.35, "syntax": 0.25, "style": 0.2, "confidence": 0.2}
DEFAULT_CONFIDENCE = 0.75
FLAG_BELOW = 0.45
BRANCHES = ("branch_c", "branch_b", "branch_a")
FIGURE_RANKING = ("multi-panel", "plot", "diagram", "photo", "screenshot", "figure")


def to_three(x: Column) -> Column:
    """Rounded to three places, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def judged(candidates: DataFrame) -> DataFrame:
    """Candidates with ``weighted``, the weighted sum of their scores."""
    total = F.lit(0.0)
    for c, w in WEIGHTS.items():
        total = total + F.lit(w) * F.col(c)
    return candidates.withColumn("weighted", to_three(total))


def ranked(candidates: DataFrame, group: list[str], score: str = "weighted") -> DataFrame:
    """Candidates with their rank inside a group; equal scores keep their order."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), "pos")))


def branch_confidence(average: Column, confidence: Column, coverage: Column) -> Column:
    """The first known of three measures, 0.1 at least; a default where none is."""
    known = F.coalesce(average, confidence, coverage)
    return F.when(known.isNull(), DEFAULT_CONFIDENCE).otherwise(F.greatest(F.lit(0.1), known))


def branch_weighted(candidates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Candidates with ``weight``: their score (0.05 at least) times their branch's confidence. ``metrics`` has one row a branch."""
    out = candidates.join(F.broadcast(metrics.select("branch", F.col("confidence").alias("_c"))), "branch", "left")
    return out.withColumn("weight", F.greatest(F.lit(0.05), F.col("weighted")) * F.coalesce("_c", F.lit(DEFAULT_CONFIDENCE))).drop("_c")


def fused(candidates: DataFrame, weight: str = "weighted", k: int = 3, floor: float = 0.5) -> DataFrame:
    """For each chunk its k best candidates as one: sources, and scores averaged by weight."""
    top = ranked(candidates, ["chunk_id"], weight).where(F.col("rank") <= k)
    w = Window.partitionBy("chunk_id")
    total = F.sum(weight).over(w)
    top = top.withColumn("share", F.col(weight) / F.when(total == 0, 1.0).otherwise(total))
    mean = lambda c: F.round(F.sum(F.col("share") * F.col(c)), 6).alias(c)
    return top.groupBy("chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), "+").alias("sources"),
        F.greatest(F.max(F.when(F.col("rank") == 1, F.col("confidence"))), F.lit(floor)).alias("confidence"),
        mean("math"),
        mean("syntax"),
        mean("style"),
    )


def rule_choice(candidates: DataFrame, specialist: str) -> DataFrame:
    """For each chunk the first candidate (by rank) that its region's rule takes, else the one with the best syntax."""
    rule = (F.col("region").isin("equation", "formula") & (F.col("math") >= 0.5)) | (F.col("region").isin("table", "figure") & F.col("source").startswith(specialist))
    w = Window.partitionBy("chunk_id").orderBy(F.when(rule, 0).otherwise(1), F.when(rule, 0.0).otherwise(-F.col("syntax")), "rank")
    return ranked(candidates, ["chunk_id"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("chunk_id", F.col("pos").alias("chosen"), "source")


def votes(candidates: DataFrame, threshold: float) -> DataFrame:
    """For each chunk its best candidate and that one's share of all weights; none below the threshold."""
    total = F.sum(F.abs("weighted"))
    out = candidates.groupBy("chunk_id").agg(F.max("weighted").alias("best"), F.min_by("pos", F.struct(-F.col("weighted"), F.col("pos"))).alias("winner"), total.alias("total"))
    share = F.least(F.lit(1.0), F.abs("best") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
    return out.where(F.col("best") >= threshold).select("chunk_id", "winner", F.round(share, 6).alias("share"))


def best_branch(results: DataFrame, key: str) -> DataFrame:
    """The first finished branch in order of preference; the last of these where none finished."""
    rank = F.array_position(F.array(*(F.lit(b) for b in BRANCHES)), F.col("branch"))
    done = F.when(F.col("status") == "completed", rank)
    return results.groupBy(key).agg(F.element_at(F.array(*(F.lit(b) for b in BRANCHES)), F.coalesce(F.min(done), F.lit(len(BRANCHES))).cast("int")).alias("branch"))


def mode(rows: DataFrame, group: str, label: str, ranking: tuple[str, ...] = FIGURE_RANKING) -> DataFrame:
    """The most frequent label of each group; of equally frequent ones the first in the ranking."""
    n = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*(F.lit(r) for r in ranking)), F.col(label))
    return n.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), place)).alias("mode"))


def status_summary(rows: DataFrame, group: str) -> DataFrame:
    """Mean and highest confidence of rows that went well, and how many failed."""
    ok = F.when(F.col("status") == "ok", F.col("confidence"))
    return rows.groupBy(group).agg(F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.max(ok), F.lit(0.0)).alias("most"), F.count_if(~F.col("status").eqNullSafe("ok")).alias("failures"))


def alternatives(rows: DataFrame, fallback: Column) -> DataFrame:
    """A snippet's candidates: itself, its plain text where it doesn't hold that already, and a caption where there is one."""
    own = rows.select("chunk_id", F.lit("specialist").alias("source"), "latex", F.lit(0.55).alias("confidence"))
    plain = rows.withColumn("_f", fallback).where((F.col("_f") != "") & ~F.contains("latex", F.col("_f")))
    plain = plain.select("chunk_id", F.lit("chunk-text").alias("source"), F.concat(F.lit(r"\par "), "_f", F.lit(" \\")).alias("latex"), F.lit(0.2).alias("confidence"))
    extra = rows.where("caption is not null").select("chunk_id", F.lit("branch_b_vision").alias("source"), F.concat(F.lit("% branch:branch_b\n"), "caption").alias("latex"), F.lit(0.5).alias("confidence"))
    return own.unionByName(plain).unionByName(extra)


def ratio(count: Column, expected: Column) -> Column:
    """count / expected, 1 at most and to three places; 1 where nothing is expected."""
    return F.when(expected == 0, 1.0).otherwise(to_three(F.least(count, expected) / expected))


def provenance_scores(rows: DataFrame) -> DataFrame:
    """By document, over chunks (region_type, vision, layout): coverage, consistency and confidence of the second branch's regions."""
    linked = F.col("vision").isNotNull()
    missed = F.when(linked, (F.col("vision") != "") & (F.col("vision") != F.col("region_type"))).otherwise(F.col("region_type").isin("figure", "table", "equation"))
    p = rows.groupBy("doc_id").agg(F.count_if(linked).alias("linked"), F.count_if(missed).alias("missed"), F.count("*").alias("n"), F.coalesce(F.avg(F.when(linked, F.col("layout"))), F.lit(0.7)).alias("confidence"))
    consistency = F.when(F.col("linked") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("missed") / F.greatest("linked", F.lit(1))))
    return p.select("doc_id", to_three(F.col("linked") / F.col("n")).alias("coverage"), to_three(consistency).alias("consistency"), to_three(F.col("confidence")).alias("confidence"))


def layout_scores(rows: DataFrame) -> DataFrame:
    """By document: how the headings, tables and equations of snippets match those of chunks."""
    found = lambda p: F.coalesce(F.sum(F.regexp_count("latex", F.lit(p))), F.lit(0))
    kind = lambda *k: F.count_if(F.col("region_type").isin(*k))
    p = rows.groupBy("doc_id").agg(
        F.count_if(F.col("header_level") > 0).alias("h"), kind("table").alias("t"), kind("equation", "formula").alias("e"), kind("figure").alias("f"), F.avg("layout").alias("layout"),
        found(r"(?i)\\section\{|\\subsection\{").alias("lh"), found(r"(?i)\\begin\{table").alias("lt"), found(r"(?i)\\begin\{(equation|align|gather)").alias("le"), found(r"(?i)\\includegraphics").alias("lf"),
    )
    return p.select("doc_id", ratio(F.col("lh"), F.col("h")).alias("heading_alignment"), ratio(F.col("lt"), F.col("t")).alias("table_alignment"), ratio(F.col("le"), F.col("e")).alias("math_alignment"), ratio(F.col("lf"), F.col("f")).alias("figure_alignment"), to_three(F.col("layout")).alias("layout_confidence"))


def table_diff(expected: DataFrame, generated: DataFrame) -> DataFrame:
    """By document, over tables (doc_id, pos, columns) zipped in order: match of columns and of counts, and the mean difference."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    a = expected.select("doc_id", F.row_number().over(w).alias("k"), F.col("columns").alias("a"))
    b = generated.select("doc_id", F.row_number().over(w).alias("k"), F.col("columns").alias("b"))
    p = a.join(b, ["doc_id", "k"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("b").alias("m"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("delta"), F.max("a").alias("most"))
    none = F.col("m") == 0
    match = F.greatest(F.lit(0.0), 1.0 - F.least(F.col("delta") / F.greatest("most", F.lit(1)), F.lit(1.0)))
    return p.select("doc_id", F.when(none, 0.0).otherwise(to_three(match)).alias("columns_match"), F.when(none, 0.0).otherwise(ratio(F.col("m"), F.col("n"))).alias("count_match"), F.when(none, 1.0).otherwise(to_three(F.col("delta"))).alias("column_delta"))


def overall(structural: Column, content: Column, visual: Column, semantic: Column, confidence: Column, errors: Column) -> Column:
    """The roll-up of four composites, lowered for low confidence and for errors."""
    base = 0.3 * structural + 0.3 * content + 0.2 * visual + 0.2 * semantic
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (0.85 + 0.15 * confidence) - F.when(errors, 0.05).otherwise(0.0)))


def reward(syntax: Column, semantic: Column, aesthetic: Column, cross: Column) -> Column:
    """Weighted reward, a tenth of it from the cross-validation where that isn't zero."""
    total = 0.5 * syntax + 0.3 * semantic + 0.2 * aesthetic
    return F.when(cross != 0, 0.9 * total + 0.1 * cross).otherwise(total)


def tier(aggregate: Column) -> Column:
    return F.when(aggregate <= 0.45, "low").when(aggregate >= 0.75, "high").otherwise("medium")


def branch_strategy(signal: Column, consistency: Column) -> Column:
    return F.when(signal < 0.2, "ocr-only").when(consistency < 0.5, "vision-scout").when((signal >= 0.6) & (consistency >= 0.6), "vision-hybrid").otherwise("vision-scout")
