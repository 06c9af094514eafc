"""Closing concepts: guarded, evidenced, never undone by accident.

A closing names a concept, a reason and, for a merge, a successor.  Guards are
checked in a fixed order and the first that fails is the refusal; a refused
closing leaves the log as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelae.functions.identity import concept_identity
from stelae.functions.normalize import normalized
from stelae.operators.graph import REOPENED, RETIRED, SUPERSEDED, KnowledgeGraph, is_current

# How refusals are worded.
NOT_HELD = "nothing published a concept named %s to close"
CLOSED_ALREADY = "a concept named %s is already %s"
ITSELF = "a concept cannot supersede itself"
SUCCESSOR_NOT_HELD = "nothing published a concept named %s to merge into"
NOT_HELD_TO_REOPEN, CURRENT_ALREADY = "nothing published a concept named %s to reopen", "a concept named %s is current"

CLOSINGS = "name string, into string, because string, merging boolean"


def _closed_as() -> Column:
    return F.when(F.coalesce(F.col("successor"), F.lit("")) != "", F.lit("superseded")).otherwise(F.lit("retired"))


def verdicts(closings: DataFrame, graph: KnowledgeGraph) -> DataFrame:
    """Every proposed closing with its ``concept``, ``successor`` and ``refusal``.

    Each is judged on its own against ``graph``; ``refusal`` is null if it may be
    recorded.  ``into`` is null unless ``merging``.
    """
    held = graph.concepts.select(
        F.col("concept"), is_current(F.col("standing")).alias("is_current"), _closed_as().alias("closed_as")
    )
    asked = closings.withColumns(
        {
            "concept": concept_identity(F.col("name")),
            "successor": F.when(F.col("merging"), concept_identity(F.col("into"))),
            "reason": normalized(F.coalesce("because", F.lit(""))),
        }
    )
    own = held.select("concept", F.col("is_current").alias("own_current"), F.col("closed_as").alias("own_closed"))
    into = held.select(
        F.col("concept").alias("successor"), F.col("is_current").alias("into_current"), F.col("closed_as").alias("into_closed")
    )
    merging = F.coalesce("merging", F.lit(False))
    refusal = (
        F.when(F.col("reason") == "", F.lit("a reason is required"))
        .when(F.col("own_current").isNull(), F.format_string(NOT_HELD, "name"))
        .when(~F.col("own_current"), F.format_string(CLOSED_ALREADY, "name", "own_closed"))
        .when(merging & F.col("into").isNull(), F.lit("a successor is required"))
        .when(merging & (F.col("successor") == F.col("concept")), F.lit(ITSELF))
        .when(
            merging & F.col("into_current").isNull(),
            F.format_string(SUCCESSOR_NOT_HELD, "into"),
        )
        .when(
            merging & ~F.col("into_current"), F.format_string(CLOSED_ALREADY, "into", "into_closed")
        )
    )
    return (
        asked.join(own, "concept", "left")
        .join(into, "successor", "left")
        .select("name", "into", "merging", "reason", "concept", "successor", refusal.alias("refusal"))
    )


def publications(judged: DataFrame, next_seq: int, at: int | None) -> DataFrame:
    """The log rows of accepted closings, numbered from ``next_seq`` by name."""
    from stelae.sources.record_log import with_positions

    numbered = with_positions(judged.filter(F.col("refusal").isNull()), ["name", "successor", "reason"])
    return numbered.select(
        (F.col("position") + F.lit(next_seq - 1)).cast("long").alias("seq"),
        F.lit("concept").alias("kind"),
        F.when(F.coalesce("merging", F.lit(False)), F.lit(SUPERSEDED)).otherwise(F.lit(RETIRED)).alias("standing"),
        F.coalesce("successor", F.lit("")).alias("successor"),
        F.col("reason").alias("because"),
        F.lit("").alias("ref"),
        F.col("name").alias("text"),
        F.lit("").alias("source"),
        F.lit("").alias("scope"),
        F.lit(at).cast("long").alias("at"),
    )


def reopenings(asked: DataFrame, graph: KnowledgeGraph) -> DataFrame:
    """Every proposed reopening (``name, because``) with ``concept`` and ``refusal``:
    a reason is required, and a concept that is not held or is current cannot be
    reopened."""
    held = graph.concepts.select("concept", is_current(F.col("standing")).alias("_current"))
    named = asked.withColumns({"concept": concept_identity(F.col("name")), "reason": normalized(F.coalesce("because", F.lit("")))})
    refusal = (
        F.when(F.col("reason") == "", F.lit("a reason is required"))
        .when(F.col("_current").isNull(), F.format_string(NOT_HELD_TO_REOPEN, "name"))
        .when(F.col("_current"), F.format_string(CURRENT_ALREADY, "name"))
    )
    return named.join(held, "concept", "left").select("name", "concept", "reason", refusal.alias("refusal"))


def reopened(judged: DataFrame, next_seq: int, at: int | None) -> DataFrame:
    """The log rows of accepted reopenings, numbered from ``next_seq`` by name."""
    from stelae.sources.record_log import with_positions

    empty = F.lit("")
    return with_positions(judged.filter(F.col("refusal").isNull()), ["name", "reason"]).select(
        (F.col("position") + F.lit(next_seq - 1)).cast("long").alias("seq"), F.lit("concept").alias("kind"), F.lit(REOPENED).alias("standing"),
        empty.alias("successor"), F.col("reason").alias("because"), empty.alias("ref"), F.col("name").alias("text"),
        empty.alias("source"), empty.alias("scope"), F.lit(at).cast("long").alias("at"),
    )
