"""Readers and writers of the engine's records, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.files import folder_of

CHUNK = "chunk_id STRING, page INT, text STRING, images ARRAY<STRING>, metadata STRING"
PLAN_BLOCK = "block_id STRING, chunk_id STRING, label STRING, block_type STRING, images ARRAY<STRING>, metadata STRING"
SNIPPET = "chunk_id STRING, latex STRING, notes STRING, branch STRING"


def read_json_array(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """Records of a pretty-printed JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line; nulls are left out."""
    df.write.mode(mode).json(path)


def read_tex_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Whole ``*.tex`` files below ``root``, with the first folder as domain (null for files right in it)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.tex")
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), folder_of(path, root).alias("domain"), "value")


def markdown_paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The trimmed paragraphs between blank lines, numbered."""
    parts = docs.select("doc_id", F.posexplode(F.split(text_col, "\n\n")).alias("at", "paragraph"))
    return parts.select("doc_id", "at", F.trim("paragraph").alias("paragraph")).where("paragraph <> ''")
