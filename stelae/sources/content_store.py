"""The document store: opaque octets under their identity."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions.identity import document_identity
from stelae.session import CODEC, Scratch

DOCUMENTS = "document string, content binary, length long"


class NoSuchDocument(LookupError):
    """An address that holds nothing."""


def addressed(contents: DataFrame, content: str = "content") -> DataFrame:
    """``document, content, length`` of every row; null contents are left out."""
    return contents.filter(F.col(content).isNotNull()).select(
        document_identity(F.col(content)).alias("document"),
        F.col(content).alias("content"),
        F.octet_length(content).cast("long").alias("length"),
    )


def admissions(contents: DataFrame, held: DataFrame, content: str = "content") -> DataFrame:
    """A receipt per distinct content: ``document, length, admission``.

    ``vacuous`` for no octets, else ``already present`` or ``stored``.
    """
    offered = addressed(contents, content).select("document", "length").distinct()
    known = held.select("document", F.lit(True).alias("_held")).distinct()
    verdict = (
        F.when(F.col("length") == 0, F.lit("vacuous"))
        .when(F.col("_held").isNotNull(), F.lit("already present"))
        .otherwise(F.lit("stored"))
    )
    return offered.join(known, "document", "left").select("document", "length", verdict.alias("admission"))


def collisions(held: DataFrame) -> DataFrame:
    """Addresses under which different octets lie."""
    digests = held.select("document", F.sha2("content", 256).alias("_digest")).distinct()
    return digests.groupBy("document").agg(F.count("*").alias("contents")).filter("contents > 1")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of files, read whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


class DocumentStore:
    """Documents under a folder, or of this session only where ``root`` is None."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.durable = spark, root is not None
        self.scratch = Scratch(spark, "documents")
        self.path = os.path.join(root, "documents") if root is not None else self.scratch.path("documents")
        spark.createDataFrame([], DOCUMENTS).write.mode("append").parquet(self.path)

    def is_durable(self) -> bool:
        return self.durable

    def documents(self) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS).parquet(self.path)

    def write(self, contents: DataFrame, content: str = "content") -> DataFrame:
        """Store what is new; returns the receipts.  The only way in."""
        receipts = self.scratch.keep(admissions(contents, self.documents(), content), f"receipts-{uuid.uuid4().hex[:8]}")
        fresh = (
            addressed(contents, content)
            .join(receipts.filter(F.col("admission") == "stored").select("document"), "document", "left_semi")
            .dropDuplicates(["document"])
        )
        fresh.select("document", "content", "length").write.mode("append").option("compression", CODEC).parquet(self.path)
        return receipts

    def holds(self, addresses: DataFrame) -> DataFrame:
        """The addresses that hold a document."""
        return addresses.join(self.documents().select("document"), "document", "left_semi")

    def read(self, document: str) -> bytes:
        """The octets under an address; never empty octets for an absent one."""
        found = self.documents().filter(F.col("document") == document).select("content").head(1)
        if not found:
            raise NoSuchDocument(document)
        return bytes(found[0].content)

    def identities(self) -> DataFrame:
        return self.documents().select("document").orderBy("document")

    def length(self) -> int:
        return self.documents().count()

    def is_empty(self) -> bool:
        return self.documents().isEmpty()
