"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one tags every record with a bucket by a seeded hash of all its columns, and writes
it: buckets are as large as a task's memory allows and alike in size, whatever keys the
records have. Pass two gathers each bucket, shuffles it, and numbers its records from the
sum of the buckets before. A record's number modulo the shard count is its shard, so
counts differ by one at most.

The shuffle of a bucket draws a number for each record by a second seeded hash and sorts
by it: every order is as likely as by Fisher-Yates, whose swaps can't be said of immutable
arrays. Spark's own ``shuffle``, which does swap, is seeded by the partition and would make
the result depend on the layout of the input and on which tasks ran again. Here it depends
on the records alone; only copies of a whole record that would fill a bucket are told
apart by their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

SHARDS = 40
SEED = 20_261
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 50_000
#: Of each record besides its text.
RECORD_BYTES = 16
#: Up to so many buckets, their offsets are broadcast (16 bytes each); also the records repeated so often.
BROADCAST_BUCKETS = 500_000
#: Buckets that one window numbers.
RUN_BUCKETS = 4096


def _numbered(counts: DataFrame) -> DataFrame:
    """(bucket, offset): the sum of ``n`` over smaller buckets, by runs of buckets, so that no window holds them all."""
    counts = counts.withColumn("_run", F.floor(F.col("bucket") / RUN_BUCKETS))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("_run").agg(F.sum("n").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counts.join(runs, "_run").select("bucket", (F.col("_before") + F.col("_inside")).alias("offset"))


def shuffle_into_shards(records: DataFrame, text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``records`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    These two replace columns so named. Nulls in any column, empty texts and repeated rows
    are records like others; which of equal rows gets which slot is open. A text larger
    than ``bucket_bytes`` makes its bucket so much larger. The same records get the same
    places however they are dealt to files and partitions, unless copies of one record
    make more than a quarter of a bucket. Maps are compared by their JSON.
    """
    own = [c for c in records.columns if c not in ("shard", "slot")]
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    hashed = [F.to_json(F.struct(c)) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(c) for c in own]
    bytes_ = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + RECORD_BYTES).cast("bigint")
    marks = [F.xxhash64(F.lit(k), *hashed).alias(f"h{k}") for k in (1, 2)]
    tagged = records.select(F.struct(*(F.col(c) for c in own)).alias("record"), *marks, bytes_.alias("bytes"))
    tagged = materialize(tagged, "tagged")
    total = tagged.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(1, -(-(total.bytes or 0) // bucket_bytes), -(-total.n // BUCKET_ROWS))
    same = tagged.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    many = materialize(same.where((F.col("n") > 1) & ((F.col("n") > BUCKET_ROWS // 4) | (F.col("bytes") > bucket_bytes // 4))).select("h1", "h2", F.lit(True).alias("many")), "repeated")
    n_many, salt = many.count(), F.lit(0).cast("bigint")
    if n_many:
        tagged = tagged.join(F.broadcast(many) if n_many <= BROADCAST_BUCKETS else many, ["h1", "h2"], "left")
        salt = F.when(F.col("many"), F.monotonically_increasing_id()).otherwise(salt)
    bucket = F.pmod(F.xxhash64("h1", "h2", salt, F.lit(seed)), F.lit(buckets))
    scattered = tagged.select("record", F.xxhash64("h2", "h1", F.lit(seed)).alias("draw"), "h1", bucket.alias("bucket"))
    if n_many:
        scattered = materialize(scattered, "scattered")  # places are drawn once

    offsets = _numbered(scattered.groupBy("bucket").agg(F.count("*").alias("n")))
    by_draw = lambda a, b: F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).when(a["h1"] < b["h1"], -1).when(a["h1"] > b["h1"], 1).otherwise(0)
    dealt = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("draw", "h1", "record")), by_draw).alias("rows"))
    dealt = dealt.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "bucket")
    dealt = dealt.select("offset", F.posexplode("rows").alias("at", "row"))
    number = F.col("offset") + F.col("at")
    return dealt.select(F.col("row.record").alias("record"), F.pmod(number, F.lit(shards)).cast("int").alias("shard"), F.floor(number / shards).cast("bigint").alias("slot")).select("record.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold the records in slot order."""
    n = sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = sharded.repartitionByRange(int(n), "shard", "slot").sortWithinPartitions("shard", "slot")
    parts.write.partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards; the law ``rows`` holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
