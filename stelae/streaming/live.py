"""Live variants: tables kept current while changes and records arrive.

``LiveTable`` keeps one row per subject in buckets of the subject's hash; a batch
rewrites the buckets it touches and then one manifest, which names the version of
every bucket and the last batch applied, so a batch that is
repeated after a failure is recognised and not applied twice.  ``LiveLog`` appends
records and keeps where every identity was first published, so that a batch is
checked without reading the log again.  The batch
operators stay the truth; these apply them micro-batch by micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.operators.change_feed import latest_changes
from stelae.operators.graph import LOG, first_positions, identified, violations
from stelae.session import Scratch, hadoop_path

BUCKETS = 64


class LiveTable:
    """The state of a change feed in buckets, each a folder of the batch that last wrote it."""

    def __init__(
        self, spark: SparkSession, root: str, subject: Sequence[str], order: Sequence[str], state: Sequence[str], op: str = "op",
        buckets: int = BUCKETS, identity: Sequence[str] | None = None,
    ):
        self.spark, self.root, self.op, self.buckets, self.identity = spark, root, op, buckets, identity
        self.subject, self.order, self.state = list(subject), list(order), list(state)

    def _manifests(self) -> list[int]:
        where, files = hadoop_path(self.spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))

    def _manifest(self) -> tuple[int, dict[str, int]]:
        """The last batch applied, -1 before the first, and the version of every bucket."""
        batches = self._manifests()
        if not batches:
            return -1, {}
        text = self.spark.read.text(f"{self.root}/manifests/batch-{batches[-1]}", wholetext=True).first().value
        return batches[-1], json.loads(text)

    def _read(self, versions: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.root}/batch-{batch}/_bucket={bucket}" for bucket, batch in versions.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def current(self) -> DataFrame | None:
        """The latest state with ``deleted`` rows, None before the first batch."""
        return self._read(self._manifest()[1])

    def _write_manifest(self, batch: int, versions: dict[str, int]) -> None:
        """All or nothing: the manifest is written under another name and renamed."""
        where, files = hadoop_path(self.spark, f"{self.root}/manifests/batch-{batch}")
        aside, _ = hadoop_path(self.spark, f"{self.root}/manifests/writing-{batch}")
        stream = files.create(aside, True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        files.rename(aside, where)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Apply one micro-batch; for ``foreachBatch``."""
        applied, versions = self._manifest()
        if applied >= batch:
            return
        bucket = F.pmod(F.xxhash64(*self.subject), F.lit(self.buckets)).alias("_bucket")
        touched = [str(r[0]) for r in changes.select(bucket).distinct().collect()]  # at most one per bucket
        base = self._read({b: versions[b] for b in touched if b in versions})
        state = latest_changes(changes, self.subject, self.order, self.state, self.op, base, self.identity)
        path = f"{self.root}/batch-{batch}"
        state.select("*", bucket).write.partitionBy("_bucket").mode("overwrite").parquet(path)
        where, files = hadoop_path(self.spark, path)
        written = [s.getPath().getName() for s in files.listStatus(where)]
        fresh = {n.removeprefix("_bucket="): batch for n in written if n.startswith("_bucket=")}
        self._write_manifest(batch, versions | fresh)
        for old in self._manifests()[:-2]:  # the one before stays for readers that are under way
            stale, _ = hadoop_path(self.spark, f"{self.root}/manifests/batch-{old}")
            files.delete(stale, False)
        self._remove_unnamed(versions, versions | fresh)

    def _remove_unnamed(self, before: dict[str, int], now: dict[str, int]) -> None:
        """Remove folders of buckets that neither of the last two manifests names."""
        named = {f"{batch}/{bucket}" for versions in (before, now) for bucket, batch in versions.items()}
        where, files = hadoop_path(self.spark, self.root)
        for folder in files.listStatus(where):
            name = folder.getPath().getName()
            if not name.startswith("batch-"):
                continue
            kept = [f"{name.removeprefix('batch-')}/{s.getPath().getName().removeprefix('_bucket=')}" in named for s in files.listStatus(folder.getPath())]
            if not any(kept):
                files.delete(folder.getPath(), True)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)


class LateRecord(ValueError):
    """A record that arrived after its place in the log; it is refused, not dropped."""


class LiveLog:
    """Appends records from a stream to a log table in order of ``seq``.

    Records already in the log are a repeated batch and skipped; a new record at or
    below the last ``seq``, or one whose parent was not published before it,
    stops the stream.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parents = spark, path, f"{path}-parents"
        spark.createDataFrame([], LOG).write.mode("append").parquet(path)
        spark.createDataFrame([], "kind string, ref string, first long").write.mode("append").parquet(self.parents)

    def records(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def apply(self, records: DataFrame, batch: int) -> None:
        held = self.records()
        fresh = records.join(held.select("seq"), "seq", "left_anti").select(*held.columns)
        fresh = Scratch(self.spark, "fresh").keep(identified(fresh), "records")
        bounds = fresh.agg(F.min("seq").alias("first"), F.count("*").alias("n")).first()
        if not bounds.n:
            return
        last = held.agg(F.max("seq")).first()[0] or 0
        if bounds.first <= last:
            raise LateRecord(f"record {bounds.first} came after record {last}")
        # Parents of a batch that failed before its records were appended do not count.
        earlier = self.spark.read.parquet(self.parents).filter(F.col("first") <= last)
        bad = violations(fresh, earlier=earlier).orderBy("seq").head(1)
        if bad:
            raise LateRecord(f"record {bad[0].seq}: {bad[0].error}")
        first_positions(fresh).write.mode("append").parquet(self.parents)
        fresh.select(*held.columns).write.mode("append").parquet(self.path)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
