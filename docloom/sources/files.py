"""Readers and writers of folders: exemplars, mixed corpora, ledgers, manifests, narratives, reports, event text."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.layouts import dotted

DISABLED = ("none", "off", "disable", "disabled")
EVENT = "stage STRING, status STRING, notes STRING, output_files ARRAY<STRING>, seq BIGINT"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``; if there is none ``build()`` makes it first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def folder_of(path: Column, root: str) -> Column:
    """The first folder of a file's path below ``root`` (null for files right in it), whatever its names hold elsewhere."""
    clean = F.regexp_replace(path, "^[a-z]+:/+", "/")
    start = "/" + "/".join(p for p in root.split("://")[-1].replace("file:", "").split("/") if p) + "/"
    at = F.instr(clean, F.lit(start))
    below = F.split(F.substring(clean, at + len(start), F.lit(1 << 20)), "/")
    return F.when((at > 0) & (F.size(below) > 1), below[0])


def exemplars(spark: SparkSession, root: str, domain: str | None, max_files: int = 3, max_chars: int = 1800) -> DataFrame:
    """(domain, path, text) of the first files of a domain, trimmed and cut; of ``default`` if it has none. No rows where switched off."""
    named = (domain or "default").strip()
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.tex").select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    files = files.withColumn("domain", folder_of(F.col("path"), root)).where("text <> ''")
    if named.lower() in DISABLED or max_files <= 0 or max_chars <= 0:
        return files.where("false").select("domain", "path", "text")
    rank = F.when(F.col("domain") == named, 0).when(F.col("domain") == "default", 1)
    files = files.withColumn("_rank", rank).where("_rank is not null")
    files = files.withColumn("_best", F.min("_rank").over(Window.partitionBy())).where("_rank = _best")
    kept = files.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("path"))).where(F.col("_n") <= max_files)
    return kept.select("domain", "path", F.substring("text", 1, max_chars).alias("text"))


def mixed_corpus(spark: SparkSession, root: str, fields: tuple[str, ...] = ("text",), max_bytes: int = 1 << 22) -> DataFrame:
    """(path, text) of all texts below a folder: plain files whole, records of JSON, JSON lines and Parquet by the first dotted field they have.

    Files over ``max_bytes`` are left out. Each format is read by its own reader; formats
    without files give no rows.
    """

    def small(df: DataFrame) -> DataFrame:
        return df.where(F.col("_metadata.file_size") <= max_bytes)

    def record(payload: Column) -> Column:
        return F.coalesce(*(dotted(payload, f) for f in fields))

    path = F.col("_metadata.file_path").alias("path")
    read = lambda glob, **o: small(spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=glob, **o))
    parts = [read("*.{tex,txt,md}", wholetext=True).select(path, F.col("value").alias("text")), read("*.jsonl").select(path, record(F.col("value")).alias("text"))]
    whole = read("*.json", wholetext=True).select(path, F.try_parse_json("value").alias("v"))
    each = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    parts.append(whole.select("path", F.explode(each).alias("e")).select("path", record(F.to_json("e")).alias("text")))
    if spark.read.format("binaryFile").load(root, recursiveFileLookup=True, pathGlobFilter="*.parquet").limit(1).count():
        tables = spark.read.parquet(root, recursiveFileLookup=True, pathGlobFilter="*.parquet")
        parts.append(small(tables).select(path, record(F.to_json(F.struct(*(f"`{c}`" for c in tables.columns)))).alias("text")))
    return reduce(DataFrame.unionByName, parts).where("text is not null and trim(text) <> ''")


def run_logs(spark: SparkSession, root: str, schema: str = EVENT) -> DataFrame:
    """Records of JSON lines below run folders, with the run's name; broken lines are left out."""
    logs = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(folder_of(F.col("_metadata.file_path"), root).alias("run"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"))
    return logs.where("e is not null and not (e.stage is null and e.status is null)").select("run", "e.*")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows added to a log; the log's files never change."""
    rows.write.mode("append").parquet(path)


def last_rows(spark: SparkSession, path: str, n: int, order: str = "seq") -> DataFrame:
    """The last n rows of a log, oldest first."""
    return spark.read.parquet(path).orderBy(F.desc(order)).limit(n).orderBy(order)


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """A ledger's rows; one that can't be read is moved aside (``.corrupt``), and there is none then."""
    if not exists(spark, path):
        return None
    try:
        ledger = spark.read.parquet(path)
        ledger.limit(1).count()
        return ledger
    except Exception as e:  # noqa: BLE001  (whatever makes it unreadable)
        if "CANNOT_READ" not in str(e) and "UNABLE_TO_INFER" not in str(e) and "FAILED_READ_FILE" not in str(e) and "not a Parquet" not in str(e):
            raise
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p(path), p(path + ".corrupt"))
        return None


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """All rows as one JSON array in one file: for plans and manifests, which fit a task."""
    rows = df.select(F.col(order).alias("_o"), F.to_json(F.struct(*df.columns)).alias("j")).agg(F.array_sort(F.collect_list(F.struct("_o", "j"))).alias("x"))
    rows.select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["j"]), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def branch_manifests(rows: DataFrame, path: str) -> None:
    """A folder for each branch with its artefacts' rows."""
    rows.write.mode("overwrite").partitionBy("branch").json(path)


def preference_pairs(rows: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) of rows whose two variants differ."""
    return rows.where("chosen is not null and rejected is not null and chosen <> rejected").select("prompt", "chosen", "rejected")


def narrative(events: DataFrame, key: str = "run") -> DataFrame:
    """(key, markdown): a run's events as a readable list in their order."""
    outputs = F.coalesce(F.col("output_files"), F.array().cast("array<string>"))
    listed = F.when(F.size(outputs) > 0, F.concat(F.lit(" → "), F.array_join(F.transform(outputs, lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", "))).otherwise("")
    line = F.rtrim(F.concat(F.lit("- **"), F.coalesce("stage", F.lit("unknown")), F.lit("** `"), F.coalesce("status", F.lit("unknown")), F.lit("` "), F.coalesce("notes", F.lit("")), listed))
    got = events.select(key, "seq", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x"))
    head = F.concat(F.lit("# Data Pathway — Run "), F.col(key).cast("string"), F.lit("\n\n## Stage Timeline\n\n"))
    return got.select(key, F.concat(head, F.array_join(F.transform("x", lambda v: v["line"]), "\n"), F.lit("\n")).alias("markdown"))


def lineage_report(versions: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, report): versions (key, version, parent, score) best first, and edges (key, src, dst, relation) in their order, as LaTeX rows."""
    row = F.concat_ws(" & ", "version", F.coalesce("parent", F.lit("-")), F.format_string("%.3f", F.col("score")))
    v = versions.select(key, "score", "version", F.concat(row, F.lit(r" \\")).alias("row")).groupBy(key).agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "version", "row"))).alias("v"))
    e = edges.select(key, "src", "dst", F.concat(F.col("src"), F.lit(r" \rightarrow "), F.col("dst"), F.lit(" ("), F.col("relation"), F.lit(")")).alias("edge")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge"))).alias("e"))
    out = v.join(e, key, "left")
    lines = F.array_join(F.transform("v", lambda x: x["row"]), "\n")
    links = F.coalesce(F.array_join(F.transform("e", lambda x: x["edge"]), "\\\\\n"), F.lit("No edges recorded."))
    return out.select(key, F.concat(F.lit("Best score: "), F.format_string("%.3f", F.col("best")), F.lit("\n"), lines, F.lit("\n"), links).alias("report"))


def event_text(events: DataFrame, kind: Column, payload: Column, order: str) -> DataFrame:
    """(order, value): events as server-sent text, one block each."""
    return events.select(order, F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n")).alias("value"))


def parse_event_text(text: Column) -> Column:
    """Events (type, data) of server-sent text; comments and pings are left out, data lines of one event joined."""
    blocks = F.filter(F.split(text, r"\n\n+"), lambda b: b.rlike("(?m)^data:"))
    lines = lambda b, k: F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith(k + ":")), lambda x: F.ltrim(F.substring(x, len(k) + 2, 1 << 30)))
    return F.transform(blocks, lambda b: F.struct(F.coalesce(F.get(lines(b, "event"), F.lit(0)), F.lit("message")).alias("type"), F.array_join(lines(b, "data"), "\n").alias("data")))


def looked_up(rows: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """Rows with what a lookup table holds of their key; without a table (offline) with nothing. Never a network call."""
    return rows if known is None else rows.join(known, key, "left")


def settings(spark: SparkSession, defaults: dict[str, str], layers: list[dict[str, str]] = (), prefix: str = "DOCLOOM_") -> dict[str, str]:
    """Settings: defaults, then layers (later ones win), then the environment by upper-case name, then the session's ``docloom.`` keys."""
    out = dict(defaults)
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    out |= {k: os.environ[prefix + k.upper()] for k in out if prefix + k.upper() in os.environ}
    return out | {k: spark.conf.get(f"docloom.{k}") for k in out if spark.conf.get(f"docloom.{k}", None) is not None}
