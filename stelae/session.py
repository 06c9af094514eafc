"""Session, shared folder and materialised intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and ``bench.py`` use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stelae")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent a folder of this process is made, set as the
    checkpoint folder and removed when the process ends.  That is for sessions in
    one process: on a cluster no machine's own folder will do, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="stelae-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def hadoop_path(spark: SparkSession, path: str):
    """A path of any file system and the file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the process ends, through Hadoop's file system, so that nothing is
    left in a cluster's shared folder either."""
    where, files = hadoop_path(spark, path)

    def remove() -> None:
        try:
            files.delete(where, True)
        except Exception:  # the JVM may be gone; only a local folder can then be reached
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)

    atexit.register(remove)


#: Codec of written tables.
CODEC = "zstd"


class Scratch:
    """Tables of one run, written as Parquet into the shared folder.

    A written table cuts the lineage, survives the loss of any executor and is
    compressed and column-pruned when it is read again, which the row format of
    ``checkpoint()`` is not.  Identities are hex, which the default codec leaves at its length.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/stelae-{label}-{uuid.uuid4().hex[:12]}"
        _removed_at_exit(spark, self.root)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", CODEC).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, name: str) -> None:
        where, files = hadoop_path(self.spark, self.path(name))
        files.delete(where, True)
