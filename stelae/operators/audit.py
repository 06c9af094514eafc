"""Audits: what was recorded, checked again without the code that recorded it.

A finding names an audit, a subject and what is wrong; ``verdict`` says whether an
audit found nothing, something, could not see, or had nothing to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stelae.functions.values import SKIPPED, UNMET
from stelae.operators.cycles import asked_on_cycles
from stelae.operators.graph import ASSERTED, SUPERSEDED, identified
from stelae.operators.ordered import previous
from stelae.session import Scratch

FINDING = "audit string, subject string, finding string"
# Exit codes of the verdicts.
VERDICTS = {"clean": 0, "failed": 1, "blind": 3, "vacuous": 4}
PRECEDENCE = ("blind", "failed", "vacuous", "clean")


def verdict(eligible: Column, examined: Column, found: Column) -> Column:
    """One audit: nothing to look at, something unseen, something wrong, or clean."""
    return (
        F.when(eligible == 0, F.lit("vacuous"))
        .when(examined < eligible, F.lit("blind"))
        .when(found > 0, F.lit("failed"))
        .otherwise(F.lit("clean"))
    )


def overall(verdicts: DataFrame) -> DataFrame:
    """The verdict of all audits together: blind, then failed, vacuous, clean."""
    rank = F.create_map(*(F.lit(x) for item in ((v, i) for i, v in enumerate(PRECEDENCE)) for x in item))
    code = F.create_map(*(F.lit(x) for item in VERDICTS.items() for x in item))
    worst = verdicts.agg(F.min(F.struct(rank[F.col("verdict")].alias("r"), F.col("verdict"))).alias("w"))
    return worst.select(F.col("w.verdict").alias("verdict"), code[F.col("w.verdict")].alias("code"))


def merges(log: DataFrame) -> DataFrame:
    """``seq, subject, finding`` of every supersession that broke a closing rule at
    its own position in the log.

    Standings as of a position are the last ones before it, of the concept itself
    and, asked among the successor's own records, of the successor.
    """
    concepts = identified(log.filter(F.col("kind") == "concept")).select("seq", "id", "standing", "successor", "because")
    before = previous(concepts, "id", "seq", F.col("standing"), "before")
    acts = before.filter(F.col("standing") == SUPERSEDED)
    told = concepts.select("id", "seq", "standing", F.lit(False).alias("asks"))
    asked = acts.select(F.col("successor").alias("id"), "seq", F.lit(None).cast("string").alias("standing"), F.lit(True).alias("asks"))
    answers = (
        previous(told.unionByName(asked), "id", "seq", F.col("standing"), "into").filter("asks").select("seq", "into")
    )
    finding = (
        F.when(F.coalesce("because", F.lit("")) == "", F.lit("no reason"))
        .when(F.col("before").isNull(), F.lit("was not held"))
        .when(F.col("before") != ASSERTED, F.lit("was closed already"))
        .when(F.col("successor") == F.col("id"), F.lit("supersedes itself"))
        .when(F.col("into").isNull(), F.lit("successor was not held"))
        .when(F.col("into") != ASSERTED, F.lit("successor was closed"))
    )
    return acts.join(answers, "seq").select("seq", F.col("id").alias("subject"), finding.alias("finding")).filter(
        F.col("finding").isNotNull()
    )


def latest_coverage(coverage_log: DataFrame) -> DataFrame:
    """The last record per document and protocol of ``seq, document, protocol, outcome``."""
    last = Window.partitionBy("document", "protocol").orderBy(F.col("seq").desc())
    return coverage_log.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") == 1).drop("_rank")


def uncovered(documents: DataFrame, coverage_log: DataFrame, protocol: str) -> DataFrame:
    """Held documents without a record under ``protocol``."""
    seen = coverage_log.filter(F.col("protocol") == protocol).select("document")
    return documents.select("document").distinct().join(seen, "document", "left_anti")


def uncovered_by_protocol(documents: DataFrame, coverage_log: DataFrame) -> DataFrame:
    """``document, protocol``: held documents without a record, for every protocol of the log.

    The log is reduced to one set of protocols per document; what a document lacks of the set
    of all protocols, a scalar of the plan, is its finding.
    """
    told = coverage_log.filter(F.col("protocol").isNotNull())
    every = told.agg(F.collect_set("protocol").alias("protocols")).scalar()
    read = told.groupBy("document").agg(F.collect_set("protocol").alias("read"))
    none = F.array().cast("array<string>")
    held = documents.select("document").distinct().join(read, "document", "left")
    return held.select("document", F.explode(F.array_except(every, F.coalesce("read", none))).alias("protocol"))


def by_fidelity(passages: DataFrame) -> DataFrame:
    """Per document of ``document, readable``: ``skipped`` if some passage needs a
    picture, ``unmet`` if all do, else null."""
    counted = passages.groupBy("document").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("readable"), 1)).alias("ok")
    )
    return counted.select(
        "document", F.when(F.col("ok") == 0, F.lit(UNMET)).when(F.col("ok") < F.col("n"), F.lit(SKIPPED)).alias("coverage")
    )


def stale(derived: DataFrame, now: DataFrame) -> DataFrame:
    """``artifact, status, path`` of derived artifacts.

    ``derived``: ``artifact, input, identity_then``; ``now``: ``input, identity_now``.
    ``unsupported`` if an input is gone, else ``stale`` if an input has changed,
    else ``propagated`` if an input is itself an artifact that is not sound, else
    ``sound``.  ``path`` says why, from the artifact to where the cause lies: of a direct
    case the least input that is gone or has changed, of a propagated one the artifacts on a
    shortest way to such an input, the least of equally short ones.  Unsoundness is passed on
    along inputs in rounds, each written, and
    each round looks only at what the last one found.
    """
    missing, moved = F.col("identity_now").isNull(), F.col("identity_now") != F.col("identity_then")
    direct = (
        derived.join(now.select("input", "identity_now"), "input", "left")
        .groupBy("artifact")
        .agg(F.min(F.when(missing, F.col("input"))).alias("gone"), F.min(F.when(moved, F.col("input"))).alias("changed"))
        .select(
            "artifact",
            F.when(F.col("gone").isNotNull(), F.lit("unsupported"))
            .when(F.col("changed").isNotNull(), F.lit("stale"))
            .otherwise(F.lit("sound"))
            .alias("status"),
            F.coalesce("gone", "changed").alias("cause"),
        )
    )
    scratch = Scratch(derived.sparkSession, "stale")
    status = scratch.keep(direct, "direct")
    way = status.filter(F.col("status") != "sound").select("artifact", F.array("artifact", "cause").alias("path"))
    frontier, known, step = way, way, 0
    edges = derived.select("artifact", "input").distinct()
    while True:
        step += 1
        reached = (
            edges.join(frontier.select(F.col("artifact").alias("input"), F.col("path").alias("_on")), "input")
            .groupBy("artifact")
            .agg(F.min("_on").alias("_on"))
            .join(known.select("artifact"), "artifact", "left_anti")
            .select("artifact", F.concat(F.array("artifact"), "_on").alias("path"))
        )
        frontier = scratch.keep(reached, f"reached-{step}")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    passed = status.join(known, "artifact", "left")
    return passed.select(
        "artifact",
        F.when((F.col("status") == "sound") & F.col("path").isNotNull(), F.lit("propagated")).otherwise(F.col("status")).alias("status"),
        F.coalesce("path", F.array().cast("array<string>")).alias("path"),
    )


def refused_cycles(derived: DataFrame, proposed: DataFrame) -> DataFrame:
    """``artifact`` of the proposed derivations (``artifact, input``) that would make an artifact
    its own ancestor, alone or together with the others: the write path appends none of these.

    Such a derivation lies on a cycle of what is held and proposed (``cycles``); what only leads to
    one, and what is held already, is not refused.
    """
    held = derived.select(F.col("artifact").alias("tail"), F.col("input").alias("head"), F.lit(False).alias("asked"))
    asked = proposed.select(F.col("artifact").alias("tail"), F.col("input").alias("head"), F.lit(True).alias("asked"))
    return asked_on_cycles(held.unionByName(asked)).withColumnRenamed("tail", "artifact")


def derive(derived: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The write path of derivations (``artifact, input, identity_then``): the log with what is
    accepted appended, and the artifacts refused because they would close a cycle."""
    refused = refused_cycles(derived, proposed)
    fine = proposed.join(refused, "artifact", "left_anti")
    return derived.unionByName(fine.select(*derived.columns)), refused


def closes_cycle(derived: DataFrame, artifact: str, inputs: list[str]) -> bool:
    """Whether deriving ``artifact`` from ``inputs`` would make it its own ancestor."""
    asked = derived.sparkSession.createDataFrame([(artifact, i) for i in inputs], "artifact string, input string")
    return not refused_cycles(derived, asked).isEmpty()


def failed_run(documents: DataFrame, readings: DataFrame) -> DataFrame:
    """``document, coverage, needs`` of a run whose caller stopped: what it did not
    come to is unmet, and says so instead of looking barren."""
    read = readings.select("document").distinct()
    return documents.select("document").distinct().join(read, "document", "left_anti").select(
        "document", F.lit(UNMET).alias("coverage"), F.lit("an answer from the reader").alias("needs")
    )


def permitted_deletes(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``refusal``: derived rows may be deleted only if they can be made
    again, so the job must be ``deterministic``, its ``inputs_complete`` and the
    delete ``scoped_to_derived`` rows.  What is not stated counts as not given."""
    given = lambda c: F.coalesce(F.col(c), F.lit(False))
    refusal = (
        F.when(~given("deterministic"), F.lit("not deterministic"))
        .when(~given("inputs_complete"), F.lit("inputs are not complete"))
        .when(~given("scoped_to_derived"), F.lit("not scoped to derived rows"))
    )
    return jobs.withColumn("refusal", refusal)
