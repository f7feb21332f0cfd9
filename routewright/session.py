"""Session and scratch-space helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    parts = shuffle_partitions or (int(cores) if cores.isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("routewright")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder. On a cluster a
    machine-local path would be lost with the machine, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="routewright-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# A file of rows of megabytes is cut into row groups of this size, looked at after every row; by
# default a writer holds a hundred rows before it looks, and a reader decodes a whole group.
_WIDE_ROWS = {
    "parquet.block.size": 16 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}


def cut_lineage(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    A lost executor then costs no recomputation, and later joins know the size.
    ``wide`` is for rows of megabytes each: what a task holds of them is bounded.
    """
    path = scratch_path(df.sparkSession, "kept")
    df.write.options(**(_WIDE_ROWS if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than cores.

    Meant for text that is costly to work on; a large table has enough splits
    and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
