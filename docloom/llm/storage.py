"""Written intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch sent to Python: bounds a worker's memory with long texts.
ARROW_ROWS = 1000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _own[app]


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches; lazy plans read the setting when they run, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Modules with caches that live as long as a Python worker, and what empties them.
_CACHES = {"docloom.llm.packing": "_memo", "docloom.llm.textblocks": "_tables"}


def release(keep: str = "") -> None:
    """Give a Python worker's free memory back to the system: workers are reused by later stages."""
    import pyarrow as pa

    for module, name in _CACHES.items():
        if module != keep and module in sys.modules:
            getattr(sys.modules[module], name).clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def frugal(run, keep: str = ""):
    """``run`` (a function for mapInArrow) that releases memory when a partition ends; ``keep`` names a module whose cache stays."""

    def lean(batches):
        if not keep:
            release()
        try:
            yield from run(batches)
        finally:
            release(keep)

    return lean


def clear(spark: SparkSession) -> None:
    """Remove this application's written tables; call it when their readers have ended."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
