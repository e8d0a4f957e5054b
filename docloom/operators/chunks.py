"""Chunks of documents, and what is read off their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

LINES_OF_A_PAGE = 4


def chunks(docs: DataFrame, lines_of_a_page: int = LINES_OF_A_PAGE) -> DataFrame:
    """One row for each non-blank line of a document, with its place, page and class; no shuffle."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))  # inside the generator, so that no later use trims again
    rows = docs.select("doc_id", "source", F.posexplode(trimmed).alias("at", "text")).where("text <> ''")
    rows = rows.select("doc_id", "source", (F.col("at") + 1).alias("pos"), "text", T.header_level(F.col("text")).alias("header_level"))
    return rows.select(
        F.concat_ws("_", F.lit("chunk"), "doc_id", "pos").alias("chunk_id"),
        "doc_id",
        "source",
        "pos",
        (F.floor((F.col("pos") - 1) / lines_of_a_page) + 1).cast("int").alias("page"),
        "text",
        T.paragraph_region(F.col("text"), F.col("header_level")).alias("region_type"),
        "header_level",
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Each chunk with the id and region of the one before and after it."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.select(
        "chunk_id",
        F.lag("chunk_id").over(w).alias("prev_chunk"),
        F.lag("region_type").over(w).alias("prev_region"),
        F.lead("chunk_id").over(w).alias("next_chunk"),
        F.lead("region_type").over(w).alias("next_region"),
    )


def ordinals(rows: DataFrame) -> DataFrame:
    """Each chunk's number inside its region class of a document."""
    w = Window.partitionBy("doc_id", "region_type").orderBy("pos")
    return rows.select("chunk_id", "region_type", F.row_number().over(w).alias("ordinal"))


def sections(rows: DataFrame) -> DataFrame:
    """Each chunk's section: the headings up to it; 0 and a fixed title before the first."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.col("region_type") == "heading"
    number = F.sum(head.cast("int")).over(w)
    title = F.last(F.when(head, F.col("text")), ignorenulls=True).over(w)
    return rows.select("chunk_id", "doc_id", "pos", "region_type", number.cast("bigint").alias("section"), F.coalesce(title, F.lit("Preamble / Introduction")).alias("title"))


def header_jumps(rows: DataFrame) -> DataFrame:
    """For each document with headings: how many there are, and how many go more than one level deeper at once."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    heads = rows.where("header_level > 0").withColumn("before", F.lag("header_level").over(w))
    jump = F.coalesce(F.col("header_level") - F.col("before") > 1, F.lit(False)).cast("int")
    return heads.groupBy("doc_id").agg(F.count("*").alias("headings"), F.sum(jump).alias("jumps"))


def heading_paths(rows: DataFrame) -> DataFrame:
    """Each heading with its parent: the last higher heading that no later one of a lower order ended."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("header_level") == 1, F.col("chunk_id")), ignorenulls=True).over(w)
    heads = rows.where("header_level > 0")
    return heads.select("chunk_id", "header_level", F.when(F.col("header_level") > 1, parent).alias("parent"))


def region_islands(rows: DataFrame, region: str, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` consecutive chunks of one class."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    numbered = rows.withColumn("n", F.row_number().over(w)).where(F.col("region_type") == region)
    island = F.col("n") - F.row_number().over(w)
    runs = numbered.withColumn("island", island).groupBy("doc_id", "island")
    return runs.agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def drop_page_repeats(rows: DataFrame) -> DataFrame:
    """Drop a chunk whose text was kept on the page before: in a run of consecutive pages with it, every second page stays."""
    pages = rows.select("doc_id", "text", "page").distinct()
    w = Window.partitionBy("doc_id", "text").orderBy("page")
    pages = pages.withColumn("run", F.col("page") - F.row_number().over(w))
    inside = Window.partitionBy("doc_id", "text", "run").orderBy("page")
    kept = pages.withColumn("k", F.row_number().over(inside)).where("k % 2 = 1").select("doc_id", "text", "page")
    return rows.join(kept, ["doc_id", "text", "page"], "left_semi")


def related(rows: DataFrame, most: int = 4, least: float = 0.3) -> DataFrame:
    """Chunk pairs at most ``most`` places apart whose word sets' Jaccard similarity is ``least`` or more.

    The next chunks come by ``lead`` over one sort, not by a join.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = rows.select("doc_id", "pos", "chunk_id", T.token_set(F.col("text")).alias("tokens"))
    after = [F.struct(F.lead("chunk_id", k).over(w).alias("target"), F.lead("tokens", k).over(w).alias("tokens")) for k in range(1, most + 1)]
    pairs = own.withColumn("after", F.array(*after)).select("chunk_id", "tokens", F.explode("after").alias("t")).where("t.target is not null")
    score = T.jaccard(F.col("tokens"), F.col("t.tokens"))
    pairs = pairs.select(F.col("chunk_id").alias("source"), F.col("t.target").alias("target"), score.alias("score"), F.slice(F.array_sort(F.array_intersect("tokens", F.col("t.tokens"))), 1, 5).alias("keywords"))
    return pairs.where(F.col("score") >= least).select("source", "target", F.round("score", 3).alias("score"), F.array_join("keywords", " ").alias("keywords"))


def numbered_references(rows: DataFrame, region: str, word: str) -> DataFrame:
    """``word`` with a number in a text, resolved to that chunk of the region in the document (null if there is none)."""
    found = rows.select("doc_id", "chunk_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(word + r"\s+([0-9]{1,6})"), F.lit(1))).alias("n"))
    found = found.select("doc_id", F.col("chunk_id").alias("source"), F.col("n").cast("int").alias("ordinal")).distinct()
    targets = ordinals(rows.where(F.col("region_type") == region)).join(rows.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "ordinal", F.col("chunk_id").alias("target"))
    return found.join(targets, ["doc_id", "ordinal"], "left").select("source", "ordinal", "target")


def heading_stack(heads: DataFrame, levels: int = 6) -> DataFrame:
    """(doc_id, pos, level, parent, path) of headings (doc_id, pos, level, text) as a stack leaves them: a heading ends all of its level and deeper.

    ``parent`` is the last higher heading's place, ``path`` the titles from the outermost one
    down to the heading. At a level the last heading counts if no higher one came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.last(F.when(F.col("level") == k, F.struct("pos", "text")), ignorenulls=True).over(w)
    rows = heads.where(F.col("level").between(1, levels)).select("doc_id", "pos", "level", "text", *(last(k).alias(f"_{k}") for k in range(1, levels)))
    open_ = []
    for k in range(1, levels):
        higher = [F.coalesce(F.col(f"_{j}.pos"), F.lit(0)) for j in range(1, k)]
        newest = F.greatest(*higher) if len(higher) > 1 else higher[0] if higher else F.lit(0)
        open_.append(F.when((F.col("level") > k) & (F.col(f"_{k}.pos") > newest), F.col(f"_{k}")))
    above = F.array_compact(F.array(*open_))
    rows = rows.select("doc_id", "pos", "level", "text", above.alias("above"))
    path = F.concat(F.transform("above", lambda x: x["text"]), F.array("text"))
    return rows.select("doc_id", "pos", "level", F.get("above", F.size("above") - 1)["pos"].alias("parent"), F.array_join(path, " / ").alias("path"))
