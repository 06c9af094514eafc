"""Read-only queries over the two worlds.

``CurrentQueries`` and ``HistoricalQueries`` are two types, so that no flag can be
forgotten.  None of them ranks or limits; listings are ordered by identity only
where they are rendered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.functions.normalize import has_all_words, words_of
from stelae.operators.graph import KnowledgeGraph


def _matching(rows: DataFrame, column: str, query: str) -> DataFrame:
    """All words of the query as substrings; a query of no words asks nothing."""
    words = words_of(query)
    return rows.filter(has_all_words(F.col(column), words)) if words else rows.limit(0)


def attached(concepts: DataFrame, claims: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims about some concepts and the citations of those claims."""
    about = claims.join(concepts.select("concept"), "concept", "left_semi")
    return about, assertions.join(about.select("claim"), "claim", "left_semi")


@dataclass(frozen=True)
class CurrentQueries:
    graph: KnowledgeGraph

    def claims_matching(self, query: str) -> DataFrame:
        return _matching(self.graph.current().claims(), "text", query)

    def concepts_matching(self, query: str) -> DataFrame:
        return _matching(self.graph.current().concepts(), "canonical_name", query)

    def neighbourhood_of(self, concept: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The concept, its current claims and the current citations of those; all
        empty if the concept is not current."""
        world = self.graph.current()
        named = world.concepts().filter(F.col("concept") == concept)
        claims, cited = attached(named, world.claims(), world.assertions())
        return named, claims, cited.select("assertion", "claim", "source", "scope")

    def concept_count(self) -> DataFrame:
        return self.graph.current().concepts().agg(F.count("*").alias("concepts"))


@dataclass(frozen=True)
class HistoricalQueries:
    graph: KnowledgeGraph

    def claims_matching(self, query: str) -> DataFrame:
        return _matching(self.graph.every_version().claims(), "text", query)

    def merge_losers(self) -> DataFrame:
        return self.graph.every_version().merge_losers()

    def neighbourhood_of(self, concept: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The concept with every claim and citation ever attached to it; claims and
        citations carry ``current`` in the composed sense."""
        held, live = self.graph.every_version(), self.graph.current()

        def flagged(rows: DataFrame, current: DataFrame, key: str) -> DataFrame:
            marks = current.select(key, F.lit(True).alias("current"))
            return rows.join(marks, key, "left").withColumn("current", F.coalesce("current", F.lit(False)))

        named = held.concepts().filter(F.col("concept") == concept)
        claims, cited = attached(named, held.claims(), held.assertions())
        return named, flagged(claims, live.claims(), "claim"), flagged(cited, live.assertions(), "assertion")

    def concept_count(self) -> DataFrame:
        return self.graph.every_version().concepts().agg(F.count("*").alias("concepts"))
