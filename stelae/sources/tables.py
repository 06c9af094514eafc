"""Named Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _row_groups(spark: SparkSession, path: str) -> int:
    """Row groups of a Parquet file, from its footer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getRowGroups().size()
    finally:
        reader.close()


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table for work that is dear per row.

    A row group is read by one task, so a table of few row groups keeps most cores idle.
    Where there are less than half as many as tasks can run at once, the rows are dealt to all of them;
    what is moved is then at most that many row groups.  A table of more is left as it is.
    """
    spark = rows.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, rows._jdf.inputFiles()  # stays in the JVM: there may be many
    if not len(files) or 2 * len(files) >= cores:
        return rows
    return rows if 2 * sum(_row_groups(spark, f) for f in files) >= cores else rows.repartition(cores)
