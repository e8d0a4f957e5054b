"""Document graphs, hierarchies, labels, and joins of chunks with plans, issues and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.chunks import sections


# How citations are written.
NUMERIC = r"\[([0-9]+(?:\s*(?:-|,)\s*[0-9]+)*)\]"
AUTHOR_YEAR = r"(\([A-Z][A-Za-z\-\s']+?,\s*(?:19[0-9]{2}|20[0-9]{2})\))"
CITE = r"\\cite[t|p|alp|author|year]*\{([^}]+)\}"


def document_graph(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, id, type) and edges (doc_id, source, target, type): a document contains sections, a section orders chunks."""
    rows = sections(chunks)
    section = F.format_string("section_%03d", F.col("section"))
    heads = rows.select("doc_id", section.alias("id")).distinct()
    content = rows.where("region_type <> 'heading'").select("doc_id", section.alias("section_id"), F.concat(F.lit("content_"), "chunk_id").alias("id"))
    root = F.lit("document_root")
    nodes = docs.select("doc_id", root.alias("id"), F.lit("document").alias("type")).unionByName(heads.withColumn("type", F.lit("section"))).unionByName(content.select("doc_id", "id", F.lit("chunk").alias("type")))
    edges = heads.select("doc_id", root.alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type")).unionByName(content.select("doc_id", F.col("section_id").alias("source"), F.col("id").alias("target"), F.lit("orders").alias("type")))
    return nodes, edges


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By document: numbers of nodes, sections, chunks and edges."""
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "section").alias("sections"), F.count_if(F.col("type") == "chunk").alias("contents"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("edges"))
    return n.join(e, "doc_id", "left").select("doc_id", "nodes", "sections", "contents", F.coalesce("edges", F.lit(0)).cast("bigint").alias("edges"))


def level_ids(chunks: DataFrame) -> DataFrame:
    """Headings with an id that counts their level in the document."""
    w = Window.partitionBy("doc_id", "header_level").orderBy("pos")
    name = F.when(F.col("header_level") == 1, "chapter").otherwise("section")
    return chunks.where("header_level > 0").select("chunk_id", "doc_id", F.format_string("%s-%03d", name, F.row_number().over(w)).alias("node_id"))


def heading_titles(chunks: DataFrame) -> DataFrame:
    """Headings with the titles from the document's top down to them."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("header_level") == 1, F.col("text")), ignorenulls=True).over(before)
    return chunks.withColumn("above", above).where("header_level > 0").select("chunk_id", F.when(F.col("header_level") == 1, F.col("text")).otherwise(F.concat_ws(" > ", "above", "text")).alias("path"))


def unique_names(rows: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """A name's first use keeps it; later ones get a number from 1."""
    n = F.row_number().over(Window.partitionBy(*group, name).orderBy(order)) - 1
    return rows.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("-"), n)).otherwise(F.col(name)))


def next_edges(rows: DataFrame, group: str, node: str, order: list[str], kind: str) -> DataFrame:
    """An edge from each row to the one after it in its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select(group, F.col(node).alias("source"), F.lead(node).over(w).alias("target"), F.lit(kind).alias("type")).where("target is not null")


def lineage(events: DataFrame, good: Column) -> DataFrame:
    """Edges from a version to its parent (the user's event before) and to its outcome."""
    child = next_edges(events, "user_id", "event_id", ["ts", "event_id"], "child").select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "type")
    outcome = F.when(good, "passed").otherwise("failed")
    return child.unionByName(events.select(F.col("event_id").cast("string").alias("source"), F.concat(F.lit("run-"), "user_id").alias("target"), outcome.alias("type")))


def edges_like(edges: DataFrame, **wanted: str | None) -> DataFrame:
    """The edges that have the given values; None stands for any."""
    for c, v in wanted.items():
        if v is not None:
            edges = edges.where(F.col(c) == v)
    return edges


def enriched(issues: DataFrame, chunks: DataFrame, plan: DataFrame, snippets: DataFrame) -> DataFrame:
    """Issues (chunk_id, reason) with their chunk, block and snippet, each with defaults where there is none."""
    out = issues.join(chunks.select("chunk_id", "page", "text"), "chunk_id", "left").join(plan.select("chunk_id", "block_type", "label"), "chunk_id", "left").join(snippets.select("chunk_id", "latex"), "chunk_id", "left")
    document = F.col("chunk_id") == "__document__"
    return out.select(
        "chunk_id",
        "reason",
        "page",
        F.coalesce("block_type", F.when(document, "document")).alias("block_type"),
        F.coalesce("label", F.when(document, "Document"), F.lit("")).alias("label"),
        F.coalesce("text", F.lit("")).alias("source_text"),
        F.coalesce("latex", F.lit("")).alias("generated"),
    )


def covered(plan: DataFrame, chunks: DataFrame, snippets: DataFrame) -> DataFrame:
    """Blocks of a plan that have both a chunk and a snippet."""
    return plan.join(chunks, "chunk_id").join(snippets, "chunk_id")


def merged_packages(requests: DataFrame, group: str, last_option: bool = False) -> DataFrame:
    """Each package once, in the order of first requests, ``hyperref`` at the end; the first option counts, or the last that was given."""
    pick = F.max_by("option", F.when(F.col("option").isNotNull(), F.col("pos"))) if last_option else F.min_by("option", "pos")
    once = requests.groupBy(group, "package").agg(F.min("pos").alias("first"), pick.alias("option"))
    order = Window.partitionBy(group).orderBy((F.col("package") == "hyperref").cast("int"), "first")
    return once.select(group, "package", "option", F.row_number().over(order).alias("place"))


def without_rival(packages: DataFrame, group: str, name: str, rival: str) -> DataFrame:
    """``name`` goes where ``rival`` is present."""
    there = F.bool_or(F.col("package") == rival).over(Window.partitionBy(group))
    return packages.withColumn("_r", there).where(~((F.col("package") == name) & F.col("_r"))).drop("_r")


def comments_before(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """(doc_id, pos, part, line): each line, with its title's comment in front of it."""
    met = lines.join(comments, lines.line == comments.title, "left")
    parts = F.array_compact(F.array(F.when(F.col("comment").isNotNull(), F.concat(F.lit("% "), "comment")), F.col("line")))
    return met.select("doc_id", "pos", F.posexplode(parts).alias("part", "line"))


def citations(rows: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, style, id) of each citation: numbers in brackets, author and year, commands."""
    t = F.col("text")
    numeric = F.transform(F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(1)), lambda x: F.struct(F.lit("numeric").alias("style"), F.concat(F.lit("numeric-"), F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit("_"))).alias("id")))
    found = F.regexp_extract_all(t, F.lit(AUTHOR_YEAR), F.lit(1))

    def author(x: Column) -> Column:
        who = F.trim(F.regexp_extract(x, r"\(([^,]+),", 1))
        name = F.regexp_replace(F.regexp_replace(F.lower(who), "[^0-9a-z]+", "-"), "^-+|-+$", "")
        return F.struct(F.lit("author-year").alias("style"), F.concat(F.lit("authyear-"), F.when(name == "", "author").otherwise(name), F.lit("-"), F.regexp_extract(x, r"([0-9]{4})\)", 1)).alias("id"))

    keys = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(CITE), F.lit(1)), lambda x: F.filter(F.transform(F.split(x, ","), lambda k: F.trim(k)), lambda k: k != "")))
    command = F.transform(keys, lambda k: F.struct(F.lit("tex-command").alias("style"), F.concat(F.lit("tex-"), k).alias("id")))
    return rows.select("doc_id", "chunk_id", F.explode(F.concat(numeric, F.transform(found, author), command)).alias("c")).select("doc_id", "chunk_id", "c.style", "c.id")


def dominant_style(found: DataFrame) -> DataFrame:
    """By document the most frequent style; numeric before author and year before commands where equal."""
    n = found.groupBy("doc_id", "style").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*(F.lit(s) for s in ("numeric", "author-year", "tex-command"))), F.col("style"))
    return n.groupBy("doc_id").agg(F.min_by("style", F.struct(-F.col("n"), rank)).alias("style"), F.sum("n").alias("mentions"))


def reward_pages(rows: DataFrame, limit: int = 4) -> DataFrame:
    """(doc_id, place, page): page 1, then pages by formulas, then by tables and figures; of equal ones that seen first."""
    w = Window.partitionBy("doc_id")
    math, layout = (rows.where(F.col("region_type").isin(*k)).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("kind", F.lit(i)) for i, k in ((1, ("formula", "equation")), (2, ("table", "figure"))))
    one = rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("first"), F.lit(0).alias("kind"))
    best = one.unionByName(math).unionByName(layout).groupBy("doc_id", "page").agg(F.min(F.struct("kind", (-F.col("n")).alias("n"), "first")).alias("k"))
    return best.select("doc_id", F.row_number().over(w.orderBy("k")).alias("place"), "page").where(F.col("place") <= limit)
