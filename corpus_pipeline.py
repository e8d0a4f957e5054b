"""A training corpus from ``documents``: five stages, each one operator of ``docloom.llm``.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. Each
result is written as Parquet and read again. Stages see the caller's other columns under
neutral names, so that none meets a name of an operator's own. SQL can't express the
stages (trained scores, XXH64, tokenizers), so ``ORACLE_SQL`` is None and tests hold them
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from docloom.llm.storage import materialize

ORACLE_SQL = None


def _veiled(docs: DataFrame):
    """``docs`` with neutral names for all columns but doc_id and text, and what gives the names back."""
    names = {c: c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(v) for c, v in names.items())), lambda df: df.select(*(F.col(v).alias(c) for c, v in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't predict as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, restored = _veiled(docs)
    return restored(toxicity.score(rows, toxicity.train(rows, labels)).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: found by SimHash and pivot tables, those further apart by MinHash, and all checked (five-word shingles, similarity 0.8 or more)."""
    rows, restored = _veiled(docs)
    return restored(near_dedup.one_of_similar(rows))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those that lost words to an earlier one hold the words left, joined by one space, and a new n_chars.

    A document that lost all its words stays, with an empty text.
    """
    rows, restored = _veiled(docs)
    found = substring_dedup.deduplicate(rows)
    changed = F.col("n_removed") > 0
    out = restored(found.withColumn("text", F.when(changed, F.struct(F.col("kept").alias("text"), changed.alias("changed"))).otherwise(F.struct("text", changed.alias("changed")))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text.changed"), F.char_length("text.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("text.text")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    rows, restored = _veiled(docs)
    return restored(decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that the documents' pieces are packed into, with the pieces' token ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
