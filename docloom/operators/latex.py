"""Chunks as LaTeX snippets, and what is read off snippets: references, units, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import latex as L
from docloom.functions import text as T

# Patterns of compiler messages and the package that brings an environment.
ENVIRONMENT_PACKAGES = {"align": "amsmath", "align*": "amsmath", "gather": "amsmath", "equation*": "amsmath", "tikzpicture": "tikz", "algorithm": "algorithm2e", "cases": "amsmath"}
LOG_CLASSES = (
    ("missing-package", r"No file `([^']+\.sty)'"),
    ("undefined-control", r"Undefined control sequence"),
    ("environment-mismatch", r'! LaTeX Error: (?:Missing|Extra) "(?:\\begin|\\end)'),
    ("undefined-reference", r"There were undefined references"),
    ("citation", r"Citation `[^']+' on page"),
    ("reference-warning", r"(?s)Package.*Warning.*Reference"),
    ("layout", r"Overfull \\hbox"),
    ("fatal", r"[Ff]atal error|Emergency stop"),
)
REPAIR_LINES = 6
REPAIR_WINDOWS = 3


def snippets(chunks: DataFrame) -> DataFrame:
    """Each chunk with ``latex``, by its class: a heading, equation, list or table with a label, else text that refers to its section."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumn("_section", F.last(F.when(F.col("region_type") == "heading", F.col("pos")), ignorenulls=True).over(w))
    t, kind = L.escape(F.col("text")), F.col("region_type")
    label = lambda p, at: F.concat(F.lit(p), F.col("doc_id"), F.lit("-"), at)
    mark = lambda p: F.concat(F.lit(r"\label{"), label(p, F.col("pos")), F.lit("}"))
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    columns = F.repeat(F.lit("c"), T.table_columns(F.col("text")))
    latex = (
        F.when(kind == "heading", put(L.heading(t, F.col("header_level")), mark("sec:")))
        .when(kind == "formula", put("\\begin{equation}\n", t, "\n\\end{equation}", mark("eq:")))
        .when(kind == "list", put("\\begin{itemize}\n\\item ", t, "\n\\end{itemize}"))
        .when(kind == "table", put("\\begin{table}\n\\begin{tabular}{", columns, "}\n\\toprule\n", F.replace(t, F.lit("|"), F.lit("&")), "\n\\end{tabular}\n\\caption{", F.col("chunk_id"), "}", mark("tbl:"), "\n\\end{table}"))
        .when(F.col("_section").isNotNull(), put(t, r" (\ref{", label("sec:", F.col("_section")), "})"))
        .otherwise(t)
    )
    return rows.withColumn("latex", latex).drop("_section")


def assemble(rows: DataFrame) -> DataFrame:
    """(doc_id, tex): a document's snippets in order, one after the other."""
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "latex"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["latex"]), "\n").alias("tex"))


def labels(rows: DataFrame) -> DataFrame:
    """(doc_id, name, chunk_id): labels set in snippets; the last chunk to set a name has it."""
    found = rows.select("doc_id", "chunk_id", "pos", F.explode(F.regexp_extract_all("latex", F.lit(r"\\label\{([^}]+)\}"), F.lit(1))).alias("name"))
    return found.groupBy("doc_id", "name").agg(F.max_by("chunk_id", "pos").alias("chunk_id"))


def references(rows: DataFrame) -> DataFrame:
    """(doc_id, source, command, target, at) of each reference command."""
    found = rows.select("doc_id", F.col("chunk_id").alias("source"), F.posexplode(F.regexp_extract_all("latex", F.lit(r"(\\(?:ref|eqref|autoref)\{[^}]+\})"), F.lit(1))).alias("at", "r"))
    return found.select("doc_id", "source", F.regexp_extract("r", r"\\([a-z]+)\{", 1).alias("command"), F.regexp_extract("r", r"\{([^}]+)\}", 1).alias("target"), "at")


def link_references(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Each reference with the label it means: by name, else by the chunk that set one; and whether it is resolved.

    Both lookups are made unique first, so a join adds no row.
    """
    by_chunk = found.groupBy("doc_id", F.col("chunk_id").alias("target")).agg(F.min("name").alias("by_chunk"))
    by_name = found.select("doc_id", F.col("name").alias("target"), F.col("name").alias("by_name"))
    out = refs.join(by_name, ["doc_id", "target"], "left").join(by_chunk, ["doc_id", "target"], "left")
    label = F.coalesce("by_name", "by_chunk")
    return out.select("source", "command", "target", label.alias("label"), F.when(label.isNull(), "unresolved").otherwise("resolved").alias("status"))


def reference_contexts(rows: DataFrame) -> DataFrame:
    """(source, context): the snippets that a chunk refers to, in the order of its references."""
    targets = labels(rows).join(rows.select("doc_id", "chunk_id", "region_type", "latex"), ["doc_id", "chunk_id"]).select("doc_id", F.col("name").alias("target"), "region_type", "latex")
    met = references(rows).join(targets, ["doc_id", "target"])
    piece = F.concat(F.lit("% Reference Context ("), F.col("region_type"), F.lit("):\n"), F.col("latex"))
    got = met.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("p"))
    return got.select("source", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("context"))


def section_units(rows: DataFrame) -> DataFrame:
    """(doc_id, ordinal, name, start_line, end_line, checksum): a document cut before each section command."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("latex").startswith(r"\section{").cast("int")
    unit = rows.withColumn("unit", F.sum(cut).over(w)).groupBy("doc_id", "unit")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "latex"))), lambda x: x["latex"]), "\n")
    units = unit.agg(body.alias("body"), F.sum(F.regexp_count("latex", F.lit("\n")) + 1).alias("lines"))
    order = Window.partitionBy("doc_id").orderBy("unit")
    ordinal = F.row_number().over(order) - 1
    end = F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return units.select("doc_id", ordinal.alias("ordinal"), F.format_string("section-%03d", ordinal).alias("name"), (end - F.col("lines")).alias("start_line"), end.alias("end_line"), F.sha1(F.col("body").cast("binary")).alias("checksum"))


def changed_units(units: DataFrame, cached: DataFrame) -> DataFrame:
    """The units whose checksum the cache doesn't have."""
    return units.join(cached.select("checksum").distinct(), "checksum", "left_anti")


# Compiler messages, with what they name.
MISSING_FILE = r"File `([^`]+)\.sty' not found"
UNDEFINED_COMMAND = r"Undefined control sequence[^\\]{0,120}\\([A-Za-z@]+)"
UNDEFINED_ENVIRONMENT = r"Environment ([A-Za-z*]+) undefined"
MATH_MODE = r"Missing \$ inserted|Bad math environment delimiter|Display math should end with|Illegal math"
ALIGNMENT_TABS = r"Extra alignment tab has been changed to\\cr"


def log_issues(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, code, detail, action) of what a compiler's log complains about."""
    text = F.col(log)
    many = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    issue = lambda code, detail, action: F.struct(F.lit(code).alias("code"), detail.alias("detail"), action.alias("action"))
    act = lambda kind, field, value: F.to_json(F.struct(F.lit(kind).alias("type"), value.alias(field)))
    package = F.create_map(*(F.lit(x) for kv in ENVIRONMENT_PACKAGES.items() for x in kv))
    none, fix = F.lit(None).cast("string"), F.lit('{"type":"math-mode-fix"}')

    def once(pattern: str, code: str) -> Column:
        return F.when(text.rlike(pattern), F.array(issue(code, none, fix))).otherwise(F.array().cast("array<struct<code:string,detail:string,action:string>>"))

    found = F.concat(
        F.transform(many(MISSING_FILE), lambda p: issue("missing-package", p, act("add-package", "package", p))),
        F.transform(many(UNDEFINED_COMMAND), lambda c: issue("undefined-command", c, act("define-command", "command", c))),
        F.transform(many(UNDEFINED_ENVIRONMENT), lambda e: issue("environment-undefined", e, F.when(package[e].isNotNull(), act("add-package", "package", package[e])))),
        once(MATH_MODE, "math-mode"),
        once(ALIGNMENT_TABS, "alignment-tabs"),
    )
    return logs.select(key, F.posexplode(found).alias("at", "i")).select(key, "at", "i.code", "i.detail", "i.action")


def log_classes(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, code) of each class that a log shows."""
    codes = F.array_compact(F.array(*(F.when(F.col(log).rlike(p), c) for c, p in LOG_CLASSES)))
    return logs.select(key, F.explode(codes).alias("code"))


def repair_windows(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, at, first, last): lines around the first few line numbers that a log names."""
    lines = F.slice(F.regexp_extract_all(log, F.lit(r"l\.([0-9]+)"), F.lit(1)), 1, REPAIR_WINDOWS)
    rows = logs.select(key, F.posexplode(lines).alias("at", "line"))
    return rows.select(key, "at", F.greatest(F.lit(1), F.col("line").cast("int") - REPAIR_LINES).alias("first"), (F.col("line").cast("int") + REPAIR_LINES).alias("last"))


def plan_actions(issues: DataFrame, key: str) -> DataFrame:
    """Distinct actions, each with the first issue that asked for it."""
    return issues.where("action is not null").groupBy("action").agg(F.min(key).alias("first_issue"), F.count("*").alias("issues"))
