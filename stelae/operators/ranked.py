"""Ranked retrieval from stored vectors.

Vectors are read, never derived in a query.  Queries are taken in blocks of
``BLOCK``; a block is at most ``BLOCK`` vectors and goes to every task, which keeps
the best ``k`` rows per query of what it reads; queries of several lengths are
scored length by length, each in a pass over the rows.  Only those are shuffled, the
final ranking is limited before its exchange, and each block's answer is written before the
next is asked.

Cases: null vectors, vectors with a null in them, vectors of another length than the query's and vectors of
length zero have no similarity and are not ranked; a row is not its own
neighbour; ties are ranked by id; ``k`` bounds the answer and not the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stelae.session import Scratch
from stelae.sources.record_log import with_positions

BLOCK = 4_096
_FOUND = "query long, neighbour long, similarity double"


def _unit(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which of the given vectors they are."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    flat = pc.list_flatten(vectors.take(pa.array(at)))
    matrix = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)  # nulls become NaN
    norms = np.linalg.norm(matrix, axis=1)
    usable = np.isfinite(norms) & (norms > 0)
    return matrix[usable] / norms[usable, None], at[usable]


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query, rank, neighbour, similarity``: the ``k`` rows most like each query by
    cosine."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "ranked")
    asked = with_positions(queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v")), ["q"])
    count = asked.agg(F.max("position")).first()[0] or 0
    found = spark.createDataFrame([], _FOUND)
    for start in range(0, count, block):
        part = asked.filter(F.col("position").between(start + 1, start + block)).select("q", "v").collect()
        for width in sorted({len(r.v) for r in part} - {0}):
            alike = [r for r in part if len(r.v) == width]
            scored, shared = _scored(rows, [r.q for r in alike], [r.v for r in alike], width, k, key, vector)
            order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
            ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            # Written block by block, so that neither the plan nor the broadcasts grow with the queries.
            scratch.keep(ranked, f"found/block={start}-{width}")
            shared.destroy()
    if count:
        found = spark.read.schema(f"{_FOUND}, rank int").option("recursiveFileLookup", "true").parquet(scratch.path("found"))
    else:
        found = found.withColumn("rank", F.lit(0))
    return found.select("query", "rank", "neighbour", "similarity")


def _scored(rows: DataFrame, ids: list[int], vectors: list, width: int, k: int, key: str, vector: str) -> tuple[DataFrame, Broadcast]:
    """The best ``k`` rows per query of every task, and the queries that went to all of them."""
    unit, usable = _unit(pa.array(vectors, pa.list_(pa.float64())), width)
    names = np.array(ids, np.int64)[usable]
    shared = rows.sparkSession.sparkContext.broadcast((unit, names))  # at most one block of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, labels = shared.value
        best = np.full((len(labels), 0), 0.0)
        held = np.zeros((len(labels), 0), np.int64)
        for batch in batches:
            matrix, at = _unit(batch.column(1), width)
            if not len(at):
                continue
            here = batch.column(0).to_numpy(zero_copy_only=False)[at]
            scores = asked @ matrix.T
            scores[labels[:, None] == here[None, :]] = -np.inf
            best = np.concatenate([best, scores], axis=1)
            held = np.concatenate([held, np.broadcast_to(here, scores.shape)], axis=1)
            order = np.lexsort((held, -best), axis=1)[:, :k]
            best, held = np.take_along_axis(best, order, 1), np.take_along_axis(held, order, 1)
        kept = np.isfinite(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(labels, kept.sum(axis=1))), pa.array(held[kept]), pa.array(best[kept])],
            names=["query", "neighbour", "similarity"],
        )

    scanned = rows.select(F.col(key).cast("long"), F.col(vector)).filter(F.col(key).isNotNull())
    return scanned.mapInArrow(run, _FOUND), shared
