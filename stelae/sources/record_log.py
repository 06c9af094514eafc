"""The publication log as a table and as text, and positions at scale."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stelae.operators.graph import LOG, empty_log, parsed, rendered
from stelae.session import CODEC, Scratch, hadoop_path


class LogRefused(ValueError):
    """A log that is missing or torn."""


def with_positions(
    rows: DataFrame, order: Sequence[str], name: str = "position", once: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """``rows`` with their 1-based position in ``order`` (which must be total).

    The rows are range-partitioned and sorted, each partition numbers its rows as
    they lie, and the partitions' sizes are added up: that table has one row per
    partition.  The ranges are drawn from a sample, so the numbered rows are
    written once and both uses read the same drawing; who gives a ``scratch`` drops the table
    ``numbered`` there when the positions were used.  With ``once``, equal rows count as one: they
    meet in the same range, so nothing further is moved.
    """
    place = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    ranged = rows.repartitionByRange(*order)
    numbered = (ranged.distinct() if once else ranged).sortWithinPartitions(*order).withColumn("_id", place)
    held = (scratch or Scratch(rows.sparkSession, "positions")).keep(numbered, "numbered").withColumns(
        {"_part": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}
    )
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        held.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_before") + F.col("_n"))
        .drop("_id", "_part", "_n", "_before")
    )


class AppendedTable:
    """Records of one schema under a folder, numbered by ``seq``, appended and never rewritten;
    kept with the session only where there is no folder."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None, label: str):
        self.spark, self.schema = spark, schema
        self.path = path or Scratch(spark, label).path("records")
        spark.createDataFrame([], schema).write.mode("append").parquet(self.path)

    def records(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def last(self) -> int:
        return self.records().agg(F.max("seq")).first()[0] or 0

    def append(self, rows: DataFrame) -> None:
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.records().schema.fields)).write.mode("append").option("compression", CODEC).parquet(self.path)


class PublicationLog:
    """An append-only log under a folder; one writer at a time.

    A read of a log that is not there is refused unless ``create`` is set, since
    an empty answer would be taken for an empty log.
    """

    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark, self.path = spark, os.path.join(root, "publications")
        path, files = hadoop_path(spark, self.path)
        if not files.exists(path):
            if not create:
                raise LogRefused(f"there is no log under {root}")
            empty_log(spark).write.parquet(self.path)

    def records(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def last(self) -> int:
        return self.records().agg(F.max("seq")).first()[0] or 0

    def append(self, rows: DataFrame) -> None:
        """Append numbered rows; the commit of the write makes them visible at once."""
        rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in LOG.split(", "))).write.mode("append").option("compression", CODEC).parquet(self.path)


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """``seq, record`` of a text log: one record per line, blank lines skipped.

    A last line without its line end is a torn write and refuses the log.  Lines are read
    by as many tasks as the text has splits; their order is that of file, split and line.
    """
    for torn in _torn_files(spark, path):
        raise LogRefused(f"the last record of the log has no line end: {torn}")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("record"), *place)
    kept = lines.withColumn("record", F.regexp_replace("record", "\r\\z", "")).filter(F.trim("record") != "")
    return with_positions(kept, ["_file", "_start", "_row"], "seq").select(F.col("seq").cast("long").alias("seq"), "record")


def _torn_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a text log whose last octet ends no line; one octet of each is read."""
    where, files = hadoop_path(spark, path)
    if not files.exists(where):
        raise LogRefused(f"there is no log at {path}")
    found, statuses = [], files.listStatus(where)
    for status in statuses:
        name = status.getPath().getName()
        if not status.isFile() or name.startswith(("_", ".")) or not status.getLen():
            continue
        stream = files.open(status.getPath())
        try:
            stream.seek(status.getLen() - 1)
            if stream.read() != 10:
                found.append(name)
        finally:
            stream.close()
    return found


def import_text(spark: SparkSession, path: str) -> DataFrame:
    """A text log as a table of publications with ``shaped``."""
    return parsed(text_records(spark, path))


def export_text(log: DataFrame, path: str) -> None:
    """The log as text in order, in as many part files as it has ranges."""
    rendered(log).repartitionByRange("seq").sortWithinPartitions("seq").select("record").write.mode("overwrite").text(path)
