"""Documents by their lines: Markdown blocks, runs of formulas, displays to align, environments, buffered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.functions import text as T
from docloom.functions.latex import escape

#: Regions that begin a chunk of their own.
STRUCTURAL = ("heading", "question", "answer", "figure", "table", "formula")
CHUNK_CHARS = 600
DISTANCE = 0.42
LEAST_SENTENCES = 2


def _joined(rows: DataFrame, key: str, order: list[str], text: str, name: str = "latex") -> DataFrame:
    """Each document's lines in order, joined by line ends."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("parts"))
    return parts.select(key, F.array_join(F.transform("parts", lambda p: p[text]), "\n").alias(name))


def markdown_to_latex(rows: DataFrame) -> DataFrame:
    """(doc_id, latex) from lines (doc_id, pos, line): headings, runs of bullets as lists, runs of table lines as tabulars, paragraphs."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    raw, t = F.rtrim("line"), F.trim("line")
    bar = t.startswith("|")
    rows = rows.select("doc_id", "pos", raw.alias("raw"), t.alias("t"), bar.alias("bar"), (F.regexp_count(t, F.lit(r"\|")) >= 2).alias("wide"))
    rows = rows.withColumn("island", F.sum((~F.col("bar")).cast("int")).over(w))
    rows = rows.withColumn("in_table", F.col("bar") & (F.max((F.col("bar") & F.col("wide")).cast("int")).over(Window.partitionBy("doc_id", "island").orderBy("pos")) == 1))
    title = lambda n: escape(F.trim(F.substring("raw", n, 1 << 30)), None)
    kind = F.when(F.col("raw") == "", "blank").when(F.col("raw").startswith("### "), "h3").when(F.col("raw").startswith("## "), "h2").when(F.col("raw").startswith("# "), "h1").when(F.col("t").startswith("- "), "bullet").when(F.col("in_table"), "table").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    starts = (F.col("kind") == "table") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "table")
    rows = rows.withColumn("block", F.when(F.col("kind") == "table", F.sum(starts.cast("int")).over(w)).otherwise(-F.col("pos")))
    flat = escape(F.trim(F.regexp_replace("raw", r"\s+", " ")), None)
    body = (
        F.when(F.col("kind") == "h3", F.concat(F.lit(r"\paragraph*{"), title(5), F.lit("}")))
        .when(F.col("kind") == "h2", F.concat(F.lit(r"\subsection*{"), title(4), F.lit("}")))
        .when(F.col("kind") == "h1", F.concat(F.lit(r"\section*{"), title(3), F.lit("}")))
        .when(F.col("kind") == "bullet", F.concat(F.lit(r"  \item "), escape(F.trim(F.substring("t", 3, 1 << 30)), None)))
        .when(F.col("kind") == "paragraph", F.when(flat == "", "").otherwise(F.concat(F.lit(r"\noindent "), flat, F.lit(r"\\"))))
        .otherwise("")
    )
    listed = F.col("kind") == "bullet"
    before, after = (F.coalesce(f("kind").over(w), F.lit("")) == "bullet" for f in (F.lag, F.lead))
    body = F.concat(F.when(listed & ~before, "\\begin{itemize}\n").otherwise(""), body, F.when(listed & ~after, "\n\\end{itemize}").otherwise(""))
    rows = rows.select("doc_id", "pos", "kind", "block", body.alias("body"), F.when(F.col("kind") == "table", M.table_cells(F.col("t"))).alias("cells"))
    tables = rows.where("kind = 'table'").groupBy("doc_id", "block").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda r: r["cells"]).alias("rows"))
    tables = tables.select("doc_id", "pos", M.table_environment(F.col("rows")).alias("body"))
    out = _joined(rows.where("kind <> 'table'").select("doc_id", "pos", "body").unionByName(tables), "doc_id", ["pos"], "body")
    out = out.withColumn("latex", F.btrim("latex", F.lit(" \n\t")))
    return out.withColumn("latex", F.when(F.col("latex") == "", r"\paragraph*{(empty prompt)}").otherwise(F.col("latex")))


def _with_neighbours(rows: DataFrame, holds: Column) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("held", F.coalesce(holds, F.lit(False)))
    no = F.lit(False)
    return rows.withColumn("before", F.lag("held", 1, False).over(w)).withColumn("after", F.coalesce(F.lead("held", 1).over(w), no))


def wrap_formulas(rows: DataFrame) -> DataFrame:
    """(doc_id, latex) from lines: consecutive formulas in plain text become one align environment."""
    rows = _with_neighbours(rows, M.is_mathy(F.col("line")))
    body = F.concat(F.when(~F.col("before"), "\\begin{align*}\n").otherwise(""), F.trim("line"), F.when(F.col("after"), r" \\").otherwise("\n\\end{align*}"))
    return _joined(rows.select("doc_id", "pos", F.when(F.col("held"), body).otherwise(F.col("line")).alias("body")), "doc_id", ["pos"], "body")


def align_displays(rows: DataFrame) -> DataFrame:
    """(doc_id, latex) from lines: two or more displays in a row, each an equation, become one align environment."""
    rows = _with_neighbours(rows, F.col("line").rlike(r"^\\\[.*=.*\\\]\s*$"))
    run = F.col("held") & (F.col("before") | F.col("after"))
    body = F.concat(F.when(~F.col("before"), "\\begin{align*}\n").otherwise(""), M.equation_body(F.col("line")), F.when(F.col("after"), " \\").otherwise("\n\\end{align*}"))
    return _joined(rows.select("doc_id", "pos", F.when(run, body).otherwise(F.col("line")).alias("body")), "doc_id", ["pos"], "body")


def environment_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, entry_id, kind, text) of the environments in each document's ``latex``."""
    rows = documents.select("doc_id", F.explode(M.environments(F.col("latex"))).alias("e"))
    entry = F.concat_ws("-", F.col("doc_id").cast("string"), "e.kind", F.lpad(F.col("e.at").cast("string"), 3, "0"))
    return rows.select("doc_id", entry.alias("entry_id"), "e.kind", "e.text")


def word_vector(text: Column, size: int = 256) -> Column:
    """Words counted in buckets of their MD5, as a map."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % size).cast("int"))


def _similarity(a: Column, b: Column) -> Column:
    """Cosine of two lists of buckets by their counts; 0 if one is empty."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    dot = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0), lambda s, v: s + count(x, v) * count(y, v))
    return F.coalesce(F.try_divide(dot(a, b).cast("double"), F.sqrt(dot(a, a).cast("double")) * F.sqrt(dot(b, b).cast("double"))), F.lit(0.0))


def buffered_chunks(rows: DataFrame, chunk_chars: int = CHUNK_CHARS, distance: float = DISTANCE, least_sentences: int = LEAST_SENTENCES) -> DataFrame:
    """(doc_id, page, chunk, first_pos, n, region, chars): paragraphs gathered page by page until a break.

    A chunk ends before a paragraph of another class, of a structural class, that would make it
    longer than ``chunk_chars``, or whose words differ (1 - cosine of ``distance`` or more) from
    the paragraph before it once ``least_sentences`` are gathered. Classes and similarities of
    neighbours come by a window; only lengths and sentences are folded, over one page's rows.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    rows = rows.select("doc_id", "page", "pos", "region_type", "text", word_vector(F.col("text")).alias("vector"))
    rows = rows.withColumn("_before", F.lag("vector").over(w)).withColumn("_region", F.lag("region_type").over(w))
    far = F.when(F.col("_before").isNotNull(), 1.0 - F.round(_similarity(F.col("_before"), F.col("vector")), 9) >= distance).otherwise(False)
    hard = (F.col("_region") != F.col("region_type")) | F.col("region_type").isin(*STRUCTURAL)
    rows = rows.select("doc_id", "page", "pos", "region_type", F.char_length("text").alias("chars"), F.greatest(T.sentence_count(F.col("text")), F.lit(1)).alias("sentences"), far.alias("far"), F.coalesce(hard, F.lit(False)).alias("hard"))
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "region_type", "chars", "sentences", "far", "hard"))).alias("rows"))
    state = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("sentences"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("of"))

    def step(s, r):
        full = s["sentences"] > 0
        ends = full & (r["hard"] | (s["chars"] + r["chars"] > chunk_chars) | (r["far"] & (s["sentences"] >= least_sentences)))
        chunk = s["chunk"] + ends.cast("int")
        return F.struct(
            F.when(ends, r["chars"]).otherwise(s["chars"] + r["chars"]).alias("chars"),
            F.when(ends, r["sentences"]).otherwise(s["sentences"] + r["sentences"]).alias("sentences"),
            chunk.alias("chunk"),
            F.concat(s["of"], F.array(chunk)).alias("of"),
        )

    numbered = pages.withColumn("of", F.aggregate("rows", state, step)["of"])
    rows = numbered.select("doc_id", "page", F.explode(F.arrays_zip("rows", "of")).alias("x")).select("doc_id", "page", F.col("x.of").alias("chunk"), "x.rows.*")
    return rows.groupBy("doc_id", "page", "chunk").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.max_by("region_type", "pos").alias("region"), (F.sum("chars") + 2 * (F.count("*") - 1)).alias("chars"))


def drop_repeated_figures(rows: DataFrame) -> DataFrame:
    """Of figure chunks with the same images, whatever their order, the first of a document stays; others stay all."""
    w = Window.partitionBy("doc_id", "_key").orderBy("pos")
    figure = (F.col("region_type") == "figure") & (F.size("images") > 0)
    key = F.when(figure, F.array_join(F.array_sort("images"), "\x01")).otherwise(F.concat(F.lit("\x02"), F.col("pos").cast("string")))
    return rows.withColumn("_key", key).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_key", "_k")
