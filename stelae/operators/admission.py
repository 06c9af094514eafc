"""Admission: what readers proposed becomes concepts, claims and citations.

``statements`` is one row per proposal: ``run`` (one admission of one source),
``document`` (its identity), ``scope``, ``passage`` and ``ordinal`` (order within
the run), ``concept_name`` and ``claim_text``.  A run is one admission; repeats
are refused within a run only, never between runs.

Cases: a proposal of which a half normalizes to nothing is refused and counted;
a null half counts as empty; a null scope is unstated; every aggregate is per
run and combined before its exchange, so a run with a third of all proposals is
no burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.functions.identity import assertion_identity, claim_identity, concept_identity
from stelae.functions.normalize import normalized
from stelae.functions.values import UNMET, coverage_of_run
from stelae.operators.graph import KnowledgeGraph, is_current
from stelae.session import Scratch

STATEMENTS = (
    "run long, document string, scope string, passage int, ordinal int, concept_name string, claim_text string"
)


def normal(statements: DataFrame, *further: str) -> DataFrame:
    """Proposals in normal form, with ``further`` columns as they are; ``complete`` is false
    where a half is empty."""
    half = lambda c: normalized(F.coalesce(c, F.lit(""))).alias(c)
    return statements.select(
        "run", "document", half("scope"), "passage", "ordinal", half("concept_name"), half("claim_text"), *further
    ).withColumn("complete", (F.col("concept_name") != "") & (F.col("claim_text") != ""))


def _identified(proposals: DataFrame) -> DataFrame:
    """Normal proposals with their identities; null for incomplete ones."""
    named = proposals.withColumn(
        "concept", F.when(F.col("complete"), concept_identity(F.col("concept_name"), normal=True))
    )
    claimed = named.withColumn("claim", claim_identity(F.col("concept"), F.col("claim_text"), normal=True))
    return claimed.withColumn(
        "assertion", assertion_identity(F.col("claim"), normalized(F.col("document")), F.col("scope"), normal=True)
    )


def linked(statements: DataFrame, *further: str) -> DataFrame:
    """Proposals with their identities.  A claim hangs on the concept its own proposal
    names."""
    return _identified(normal(statements, *further))


def _position():
    return F.struct("passage", "ordinal")


def citations(links: DataFrame) -> DataFrame:
    """The first of every citation of a run, with ``times`` it was made there."""
    return (
        links.filter("complete")
        .groupBy("run", "assertion", "claim", "document", "scope")
        .agg(F.count("*").alias("times"), F.min(_position()).alias("first"))
    )


def concepts(links: DataFrame) -> DataFrame:
    """One row per concept of a run, with ``mentions`` and its first position."""
    return (
        links.filter("complete")
        .groupBy("run", "concept", "concept_name")
        .agg(F.count("*").alias("mentions"), F.min(_position()).alias("first"))
    )


def coverage(found, readings, refusal=None):
    """Coverage of a reading: a refusal and no reading at all are unmet, else it looked, and
    a reading that found nothing is barren."""
    unmet = readings == 0 if refusal is None else (readings == 0) | refusal.isNotNull()
    return F.when(unmet, F.lit(UNMET)).otherwise(coverage_of_run(found))


_TEXTS = ["run", "document", "scope", "concept_name", "claim_text"]


def combined(statements: DataFrame) -> DataFrame:
    """Proposals in normal form, each once per run, with ``times`` it was made, its last passage ``_last`` and
    its first position ``_at``; ``report`` and ``records`` are made of it."""
    return normal(statements).groupBy(*_TEXTS, "complete").agg(
        F.count("*").alias("times"), F.max("passage").alias("_last"), F.min(_position()).alias("_at")
    )


def report(
    statements: DataFrame, runs: DataFrame | None = None, known: KnowledgeGraph | None = None, made: DataFrame | None = None
) -> DataFrame:
    """One row per run: coverage, distinct concepts, claims and citations, and what
    was refused, repeated, merged or closed.

    ``runs`` (``run, document``) adds runs without statements.  With ``readings``,
    ``refusal`` and ``needs`` (``reading.examined``) those decide the coverage of every run and are reported; without, a
    run without statements is one whose reader returned no reading.
    ``closed`` counts admitted concepts that ``known`` holds closed.

    Equal normal texts have equal identities, so everything is counted on the texts,
    and what the run says again is combined before anything is shuffled.  ``made`` are
    the ``combined`` statements where they were kept.
    """
    made = combined(statements) if made is None else made
    # Per concept of a run first: one distinct count, and nothing is expanded.
    ok = F.col("complete")
    named = made.groupBy("run", "document", "concept_name", "complete").agg(
        F.sum("times").alias("times"), F.count("*").alias("cited"), F.count_distinct("claim_text").alias("claims"), F.max("_last").alias("_last")
    )
    shut = F.lit(None).cast("string")
    if known is not None:
        closed = known.concepts.filter(~is_current(F.col("standing"))).select("concept", F.col("concept").alias("_shut"))
        named = named.withColumn("concept", F.when(ok, concept_identity(F.col("concept_name"), normal=True)))
        named, shut = named.join(closed, "concept", "left"), F.col("_shut")
    complete = F.sum(F.when(ok, F.col("times")).otherwise(0))
    cited, concept_count = F.sum(F.when(ok, F.col("cited")).otherwise(0)), F.count(F.when(ok, 1))
    counted = named.groupBy("run", "document").agg(
        F.sum("times").alias("proposals"),
        (F.sum("times") - complete).alias("refused"),
        cited.alias("citations"),
        (complete - cited).alias("repeated"),
        F.sum(F.when(ok, F.col("claims")).otherwise(0)).alias("claims"),
        concept_count.alias("concepts"),
        (complete - concept_count).alias("merged"),
        F.count(shut).alias("closed"),
        F.max("_last").alias("_last"),
    )
    counts = ["proposals", "refused", "citations", "repeated", "claims", "concepts", "merged", "closed"]
    if runs is not None:
        told = [c for c in ("readings", "refusal", "needs") if c in runs.columns]
        counted = runs.select("run", "document", *told).join(counted, ["run", "document"], "left").na.fill(0, counts)
        if "readings" in told:
            refusal = F.col("refusal") if "refusal" in told else None
            return counted.withColumn("coverage", coverage(F.col("citations"), F.col("readings"), refusal)).drop("_last")
    readings = F.when(F.col("_last").isNull(), F.lit(0)).otherwise(F.lit(1))
    return counted.withColumn("coverage", coverage(F.col("citations"), readings)).drop("_last")


def corroborated(statements: DataFrame, least: int = 2) -> DataFrame:
    """Claims that at least ``least`` different documents make, and how many do.
    Identities are derived for the result only."""
    made = normal(statements).filter("complete").select("concept_name", "claim_text", "document").distinct()
    often = made.groupBy("concept_name", "claim_text").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)
    concept = concept_identity(F.col("concept_name"), normal=True)
    return often.select(claim_identity(concept, F.col("claim_text"), normal=True).alias("claim"), "documents")


def records(made: DataFrame, known: KnowledgeGraph | None = None) -> DataFrame:
    """What ``combined`` proposals publish, as texts: ``run, rank, first`` and what the identities of ``sealed``
    are derived of.  Equal normal texts have equal identities, so nothing that is moved has any:
    hex digits of a digest are longer than most texts and nothing compresses them to less than their half.
    """
    ok, none = made.filter("complete"), F.lit("")
    named = ok.groupBy("run", "concept_name").agg(F.min("_at").alias("first"))
    if known is not None:
        shut = known.concepts.filter(~is_current(F.col("standing"))).select(F.col("concept").alias("_concept"))
        named = named.join(shut, concept_identity(F.col("concept_name"), normal=True) == F.col("_concept"), "left_anti")
    claimed = ok.groupBy("run", "concept_name", "claim_text").agg(F.min("_at").alias("first"))
    return (
        named.select("run", F.lit(0).alias("rank"), "first", "concept_name", none.alias("claim_text"), none.alias("document"), none.alias("scope"))
        .unionByName(claimed.select("run", F.lit(1).alias("rank"), "first", "concept_name", "claim_text", none.alias("document"), none.alias("scope")))
        .unionByName(ok.select("run", F.lit(2).alias("rank"), F.col("_at").alias("first"), "concept_name", "claim_text", "document", "scope"))
    )


def sealed(made: DataFrame, *further: str) -> DataFrame:
    """``records`` with their identities and the fields of a publication."""
    concept = concept_identity(F.col("concept_name"), normal=True)
    claim = claim_identity(concept, F.col("claim_text"), normal=True)
    assertion = assertion_identity(claim, normalized(F.col("document")), F.col("scope"), normal=True)
    by_rank = lambda *of: F.when(F.col("rank") == 0, of[0]).when(F.col("rank") == 1, of[1]).otherwise(of[2])
    none = F.lit("")
    return made.select(
        *further, "run", "rank", "first", by_rank(F.lit("concept"), F.lit("claim"), F.lit("assertion")).alias("kind"),
        by_rank(concept, claim, assertion).alias("id"), by_rank(none, concept, claim).alias("ref"),
        by_rank(F.col("concept_name"), F.col("claim_text"), none).alias("text"), F.col("document").alias("source"), "scope",
    )


def publications(statements: DataFrame, known: KnowledgeGraph | None = None) -> DataFrame:
    """What the runs publish, in order of ``run, rank, first``: concepts that are not
    held closed, then all claims, then all citations, each once per run.
    """
    return sealed(records(combined(statements), known))


def numbered(published: DataFrame, after: int, at: int | None, scratch: Scratch | None = None) -> DataFrame:
    """Log rows of ``publications``, or of ``records`` before they are sealed, numbered from ``after + 1`` in their order.

    Positions are counted per range of the order first and added up, so that no
    single task numbers the whole batch.
    """
    from stelae.sources.record_log import with_positions

    last = ["id"] if "id" in published.columns else ["concept_name", "claim_text", "document", "scope"]
    ordered = with_positions(published, ["run", "rank", "first", *last], scratch=scratch)
    if "id" not in published.columns:
        ordered = sealed(ordered, "position")
    return ordered.select(
        (F.col("position") + F.lit(after)).alias("seq"),
        "kind", F.lit("asserted").alias("standing"), F.lit("").alias("successor"), F.lit("").alias("because"),
        "ref", "text", "source", "scope", F.lit(at).cast("long").alias("at"),
    )


def cited(made: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``position, assertion, document`` of the assertions that ``combined`` proposals make of each
    document, each once, numbered as texts and sealed afterwards."""
    from stelae.sources.record_log import with_positions

    order = ["document", "scope", "concept_name", "claim_text"]
    rows = with_positions(made.filter("complete").select(*order), order, once=True, scratch=scratch)
    claim = claim_identity(concept_identity(F.col("concept_name"), normal=True), F.col("claim_text"), normal=True)
    return rows.select("position", assertion_identity(claim, normalized(F.col("document")), F.col("scope"), normal=True).alias("assertion"), "document")


def repeats(links: DataFrame) -> DataFrame:
    """The proposals of a run that repeat a citation made earlier in it."""
    first = citations(links).filter("times > 1").select("run", "assertion", "first")
    return links.filter("complete").join(first, ["run", "assertion"]).filter(_position() > F.col("first")).drop("first")


def promoted(broader: DataFrame, narrow: DataFrame) -> DataFrame:
    """A broader claim is a new claim, derived from the narrow citations it rests on.

    ``broader``: ``promotion, concept, text``; ``narrow``: ``promotion, assertion``.
    Gives ``artifact, input, identity_then`` for ``audit.stale``, so that the broad
    claim is unsupported or stale when what it rests on is.
    """
    claims = broader.select("promotion", claim_identity(F.col("concept"), F.coalesce("text", F.lit(""))).alias("artifact"))
    return claims.join(narrow, "promotion").select(
        "artifact", F.col("assertion").alias("input"), F.col("assertion").alias("identity_then")
    ).distinct()
