"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that is unset and
    everything runs on this machine (tests), a temporary one kept for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = spark.conf.get("spark.loomqa.localShared", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="loomqa-")
        spark.conf.set("spark.loomqa.localShared", known)
    return known


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor: the
    files belong to the shared file system, not to an executor. They are
    removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomqa-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession, times: int = 1) -> int:
    """Partitions of an explicit repartition: the session's shuffle width, some times over."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * times
