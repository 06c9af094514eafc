"""The held graph: publications folded to the last version of every identity.

A log is a table of publications with an explicit ``seq``.  Every child carries
its parent's address, so no step of the fold depends on the one before it: the
records are parsed, identities derived from the records' own fields, parents'
first positions joined to children, and the last version per identity taken by a
ranking that Catalyst limits before its exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stelae.functions.identity import (
    assertion_identity,
    claim_identity,
    concept_identity,
    identity_refusal,
    is_identity,
)
from stelae.functions.normalize import normalized
from stelae.functions.values import fields_of, joined, parsed_time
from stelae.session import Scratch

LOG = (
    "seq long, kind string, standing string, successor string, because string, "
    "ref string, text string, source string, scope string, at long"
)
_COLUMNS = [c.split()[0] for c in LOG.split(", ")]
ASSERTED, RETIRED, SUPERSEDED, REOPENED = "asserted", "retired", "superseded", "reopened"
#: Fields of a record without its time.
ARITY = {"concept": 5, "claim": 6, "assertion": 7}


def is_current(standing: Column) -> Column:
    """The one definition of being current."""
    return F.coalesce(standing.isin(ASSERTED, REOPENED), F.lit(False))


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def rendered(log: DataFrame) -> DataFrame:
    """``seq, record``: every publication as one line of text."""
    head = [F.coalesce(c, F.lit("")) for c in ("kind", "standing", "successor", "because")]
    ref, text, source, scope = (F.coalesce(c, F.lit("")) for c in ("ref", "text", "source", "scope"))
    body = (
        F.when(F.col("kind") == "concept", joined(*head, text))
        .when(F.col("kind") == "claim", joined(*head, ref, text))
        .otherwise(joined(*head, ref, source, scope))
    )
    timed = F.when(F.col("at").isNull(), body).otherwise(joined(body, F.col("at").cast("string")))
    return log.select("seq", timed.alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """``LOG`` and ``shaped`` from ``seq, record``.

    A record one field longer than its kind asks, whose last field is a time, is
    timed; any other count of fields, or an unknown kind, is not ``shaped``.
    """
    field = lambda i: F.get("fields", F.lit(i))
    arity = F.create_map(*(F.lit(x) for item in ARITY.items() for x in item))[F.get("fields", F.lit(0))]
    time = parsed_time(F.element_at("fields", -1))
    count = F.size("fields")
    timed = (count == arity + 1) & time.isNotNull()
    kind = field(0)
    return (
        records.select("seq", fields_of(F.col("record")).alias("fields"))
        .select(
            "seq",
            kind.alias("kind"),
            field(1).alias("standing"),
            field(2).alias("successor"),
            field(3).alias("because"),
            F.when(kind == "concept", F.lit("")).otherwise(field(4)).alias("ref"),
            F.when(kind == "concept", field(4)).when(kind == "claim", field(5)).otherwise(F.lit("")).alias("text"),
            F.when(kind == "assertion", field(5)).otherwise(F.lit("")).alias("source"),
            F.when(kind == "assertion", field(6)).otherwise(F.lit("")).alias("scope"),
            F.when(timed, time).alias("at"),
            F.coalesce(timed | (count == arity), F.lit(False)).alias("shaped"),
        )
    )


def identified(log: DataFrame) -> DataFrame:
    """The log with each record's derived ``id``, null where it has no address; a log that
    has it already is left as it is."""
    if "id" in log.columns:
        return log
    ref = F.when(is_identity(F.col("ref")), F.col("ref"))
    text, source, scope = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "source", "scope"))
    return log.withColumn(
        "id",
        F.when(F.col("kind") == "concept", concept_identity(text))
        .when(F.col("kind") == "claim", claim_identity(ref, text))
        .when(F.col("kind") == "assertion", assertion_identity(ref, source, scope)),
    )


def _legal_standing(reopening: bool) -> Column:
    successor, because = (F.coalesce(F.col(c), F.lit("")) for c in ("successor", "because"))
    return (
        ((F.col("standing") == ASSERTED) & (successor == "") & (because == ""))
        | ((F.col("standing") == RETIRED) & (successor == "") & (because != ""))
        | ((F.col("standing") == SUPERSEDED) & is_identity(successor) & (because != ""))
        | (F.lit(reopening) & (F.col("standing") == REOPENED) & (successor == "") & (because != ""))
    )


def first_positions(log: DataFrame) -> DataFrame:
    """``kind, ref, first``: where each identity was first published, under the kind of record
    that may refer to it."""
    rows = identified(log).filter(F.col("kind").isin("concept", "claim") & F.col("id").isNotNull())
    refers = F.when(F.col("kind") == "concept", "claim").otherwise("assertion").alias("kind")
    return rows.groupBy(refers, F.col("id").alias("ref")).agg(F.min("seq").alias("first"))


def violations(log: DataFrame, reopening: bool = False, earlier: DataFrame | None = None) -> DataFrame:
    """``seq, kind, error, detail`` of every record that a replay refuses.

    ``earlier`` are the ``first_positions`` of a log that ``log`` goes on from.
    ``reopening`` admits the standing of reopened concepts.  Per record the shape counts first, then the address, then whether the parent
    was published before (at any standing), then the standing.
    """
    rows = identified(log)
    parents = first_positions(rows)
    if earlier is not None:
        parents = parents.unionByName(earlier).groupBy("kind", "ref").agg(F.min("first").alias("first"))
    shaped = F.col("shaped") if "shaped" in log.columns else F.col("kind").isin(*ARITY)
    child = F.col("kind").isin("claim", "assertion")
    error = (
        F.when(~F.coalesce(shaped, F.lit(False)), F.lit("malformed"))
        .when(child & ~is_identity(F.col("ref")), F.lit("unaddressed"))
        .when(child & ~F.coalesce(F.col("first") < F.col("seq"), F.lit(False)), F.lit("out of order"))
        .when(~F.coalesce(_legal_standing(reopening), F.lit(False)), F.lit("malformed"))
    )
    # Only children have a parent to look for; other records share one empty address,
    # which as a join key would be the hottest of all.
    children = rows.filter(child).join(parents, ["kind", "ref"], "left")
    others = rows.filter(~F.coalesce(child, F.lit(False))).withColumn("first", F.lit(None).cast("long"))
    return (
        children.unionByName(others)
        .select(
            "seq",
            "kind",
            error.alias("error"),
            F.when(error == "unaddressed", identity_refusal(F.col("ref")))
            .when(error == "out of order", F.col("ref"))
            .otherwise(F.col("standing"))
            .alias("detail"),
        )
        .filter(F.col("error").isNotNull())
    )


def first_violation(log: DataFrame, reopening: bool = False) -> DataFrame:
    """The one violation a sequential replay would stop at; no row if there is none."""
    return violations(log, reopening).orderBy("seq").limit(1)


class ReplayRefused(ValueError):
    """A log that cannot be replayed; nothing of it is used."""


def latest(log: DataFrame, kind: str) -> DataFrame:
    """The last version of every identity of ``kind``: ``id``, its fields, its
    standing and its ``seq`` and ``at``."""
    rows = identified(log.filter(F.col("kind") == kind)).filter(F.col("id").isNotNull())
    last = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return rows.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") == 1).drop("_rank", "kind")


_STANDING = ["standing", "successor", "because"]


@dataclass(frozen=True)
class KnowledgeGraph:
    """Three tables of held values with their standings; publishing makes new ones.

    ``concepts``: concept, canonical_name; ``claims``: claim, concept, text;
    ``assertions``: assertion, claim, source, scope; each with ``standing``,
    ``successor`` and ``because``.
    """

    concepts: DataFrame
    claims: DataFrame
    assertions: DataFrame

    @classmethod
    def folded(cls, log: DataFrame) -> KnowledgeGraph:
        """The graph of a log that is known to replay."""
        text, source, scope = (normalized(F.coalesce(c, F.lit(""))) for c in ("text", "source", "scope"))
        concepts, claims, assertions = (latest(log, k) for k in ("concept", "claim", "assertion"))
        return cls(
            concepts.select(F.col("id").alias("concept"), text.alias("canonical_name"), *_STANDING),
            claims.select(F.col("id").alias("claim"), F.col("ref").alias("concept"), text.alias("text"), *_STANDING),
            assertions.select(
                F.col("id").alias("assertion"), F.col("ref").alias("claim"), source.alias("source"), scope.alias("scope"), *_STANDING
            ),
        )

    @classmethod
    def replayed(cls, log: DataFrame, reopening: bool = False) -> KnowledgeGraph:
        """The graph of a log, refused as a whole at its first bad record.  Identities are
        derived once, for the check and the fold."""
        log = Scratch(log.sparkSession, "replay").keep(identified(log), "identified")
        bad = first_violation(log, reopening).collect()
        if bad:
            raise ReplayRefused(f"publication {bad[0].seq}: {bad[0].error} ({bad[0].detail})")
        return cls.folded(log)

    @classmethod
    def of_tables(cls, concepts: DataFrame, claims: DataFrame, assertions: DataFrame) -> KnowledgeGraph:
        """The graph of loaded tables: the last loaded open row of every key."""

        def last(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
            if "removed_at" in rows.columns:
                rows = rows.filter(F.col("removed_at").isNull())
            for c in ("successor", "because"):
                rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit(""))
            settled = [F.col(c).desc_nulls_last() for c in ("loaded_at", "at_seconds", *_STANDING)]
            order = Window.partitionBy(key).orderBy(*settled)
            ranked = rows.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(order))
            return ranked.filter(F.col("_rank") == 1).select(key, *columns, *_STANDING)

        def tidy(rows: DataFrame, *columns: str) -> DataFrame:
            return rows.withColumns({c: normalized(F.coalesce(c, F.lit(""))) for c in columns})

        return cls(
            tidy(last(concepts, "concept", ["canonical_name"]), "canonical_name"),
            tidy(last(claims, "claim", ["concept", "text"]), "text"),
            tidy(last(assertions, "assertion", ["claim", "source", "scope"]), "source", "scope"),
        )

    def current(self) -> CurrentWorld:
        return CurrentWorld(self)

    def every_version(self) -> HistoricalWorld:
        return HistoricalWorld(self)


@dataclass(frozen=True)
class CurrentWorld:
    """What holds now.  A claim holds if its concept does too, a citation if its
    claim does."""

    graph: KnowledgeGraph

    def concepts(self) -> DataFrame:
        return self.graph.concepts.filter(is_current(F.col("standing"))).drop(*_STANDING)

    def claims(self) -> DataFrame:
        own = self.graph.claims.filter(is_current(F.col("standing"))).drop(*_STANDING)
        return own.join(self.concepts().select("concept"), "concept", "left_semi").select("claim", "concept", "text")

    def assertions(self) -> DataFrame:
        own = self.graph.assertions.filter(is_current(F.col("standing"))).drop(*_STANDING)
        held = own.join(self.claims().select("claim"), "claim", "left_semi")
        return held.select("assertion", "claim", "source", "scope")


@dataclass(frozen=True)
class HistoricalWorld:
    """Everything ever held, with standings."""

    graph: KnowledgeGraph

    def concepts(self) -> DataFrame:
        return self.graph.concepts

    def claims(self) -> DataFrame:
        return self.graph.claims

    def assertions(self) -> DataFrame:
        return self.graph.assertions

    def merge_losers(self) -> DataFrame:
        return self.graph.concepts.filter(F.col("standing") == SUPERSEDED)
