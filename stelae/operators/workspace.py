"""One workspace: documents, log and the verbs over them.

With a root everything is durable, without one it lives with the session and the
reports say so.  Refusals come before effects: arguments are checked before data
is read, rules before anything is appended, and what is reported was recorded.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions.identity import document_identity
from stelae.functions.normalize import normalized_text
from stelae.operators import admission, closing, history, reading, tools
from stelae.operators.graph import KnowledgeGraph, empty_log
from stelae.session import Scratch
from stelae.sources.content_store import DocumentStore, addressed
from stelae.sources.record_log import AppendedTable, PublicationLog, with_positions

# How refusals are worded.
EMPTY_SCOPE = "the scope names nothing"
NO_REOPENING = "this workspace does not reopen concepts"
TWO_QUESTIONS = "ask for a count or for a time, not both"

#: One record per admission: what was read under which protocol by whom, and what came of it.
COVERAGE = "seq long, run long, document string, protocol string, reader string, outcome string, amount long, needs string, at long"
#: One record per assertion and reading that makes it.
LINEAGE = "seq long, assertion string, document string, passage int, location string, protocol string, reader string"


class Refused(ValueError):
    """An act that was not carried out."""


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None, create: bool = True, reopening: bool = False):
        self.spark, self.root, self.reopening = spark, root, reopening
        self.log_table = None if root is None else PublicationLog(spark, root, create)
        self.store = DocumentStore(spark, root)
        self._log = empty_log(spark)
        path = lambda name: None if root is None else os.path.join(root, name)
        self.coverage = AppendedTable(spark, COVERAGE, path("coverage"), "coverage")
        self.readings = AppendedTable(spark, LINEAGE, path("readings"), "readings")
        self._held: tuple[int, KnowledgeGraph] | None = None

    def kept(self) -> str:
        return "in memory only" if self.root is None else "kept"

    def log(self) -> DataFrame:
        return self._log if self.log_table is None else self.log_table.records()

    def graph(self) -> KnowledgeGraph:
        """The replayed graph; a log with a bad record is refused as a whole.  The fold is kept
        as tables and used again until something is appended."""
        last = self._last()
        if self._held is None or self._held[0] != last:
            scratch, graph = Scratch(self.spark, "held"), KnowledgeGraph.replayed(self.log(), self.reopening)
            kept = (scratch.keep(rows, name) for name, rows in (("concepts", graph.concepts), ("claims", graph.claims), ("assertions", graph.assertions)))
            self._held = last, KnowledgeGraph(*kept)
        return self._held[1]

    def _append(self, rows: DataFrame) -> None:
        if self.log_table is not None:
            self.log_table.append(rows)
        else:
            kept = Scratch(self.spark, "log").keep(self._log.unionByName(rows.select(*self._log.columns)), "log")
            self._log = kept

    def _last(self) -> int:
        return self.log().agg(F.max("seq")).first()[0] or 0

    def admit(
        self,
        sources: DataFrame,
        said: DataFrame | None = None,
        scope: str | None = None,
        at: int | None = None,
        reader: Callable | None = None,
        needed: str = reading.TEXT,
        protocol: str = "stated",
        name: str = "a person",
        readings: DataFrame | None = None,
        refusals: DataFrame | None = None,
    ) -> DataFrame:
        """Admit ``run, content``; the documents are stored whatever the reading.

        What they say comes from ``said`` of each run (``run, ordinal, concept_name,
        claim_text``), from a ``reader`` (``reading.read_with``) asked for the kind of reading
        ``needed``, or from ``readings`` and ``refusals`` made before
        (``reading.recorded_readings``); from nowhere, nothing is read.  A refused or
        misdirected reading admits no statement of its document and is reported.
        A given scope that names nothing is refused.  Returns a report per run.
        """
        if scope is not None and not normalized_text(scope):
            raise Refused(EMPTY_SCOPE)
        scratch, label = Scratch(self.spark, "admission"), F.lit(scope or "")
        addresses = scratch.keep(
            sources.filter(F.col("content").isNotNull()).select("run", document_identity(F.col("content")).alias("document")), "addresses"
        )
        if reader is not None:
            handed = addressed(sources).dropDuplicates(["document"])
            answers = scratch.keep(reading.read_with(reader, handed, protocol, name, needed), "answers")
            readings, refusals = reading.answered(answers)
        known = self.graph()
        receipts = self.store.write(sources)
        if said is not None:
            statements = said.join(addresses, "run").select(
                "run", "document", label.alias("scope"), F.lit(1).alias("passage"), "ordinal", "concept_name", "claim_text"
            )
            told = said.select("run").distinct().withColumn("readings", F.lit(1).cast("long"))
            outcome = addresses.join(told, "run", "left").na.fill(0, ["readings"]).withColumns({
                "refusal": F.lit(None).cast("string"), "needs": F.when(F.col("readings") == 0, F.lit(reading.NO_READING)),
            })
            facts = None  # one reading of each document, which makes what is admitted: numbered with it
        else:
            outcome = addresses.join(reading.examined(addresses, readings, refusals), "document")
            if readings is None:
                statements = facts = None
            else:
                given = reading.accepted(readings, outcome)
                statements = reading.statements(given, addresses, label)
                facts = reading.lineage(given, label)
        if statements is None:
            statements = self.spark.createDataFrame([], admission.STATEMENTS)
        # Statements are read, joined and combined once; what is numbered holds texts, and is dropped when it is sealed.
        made = scratch.keep(admission.combined(statements), "combined")
        reports = scratch.keep(admission.report(statements, outcome, known, made), "report")
        self._append(admission.numbered(admission.records(made, known), self._last(), at, scratch))
        scratch.drop("numbered")
        self._keep_coverage(reports, protocol, name, at)
        if said is not None:
            stated = {"passage": F.lit(1), "location": F.lit("stated"), "protocol": F.lit(protocol), "reader": F.lit(name)}
            self._append_lineage(admission.cited(made, scratch).withColumns(stated))
            scratch.drop("numbered")
        elif facts is not None:
            self._keep_lineage(facts)
        scratch.drop("combined")
        corpus = history.counts(self.log()).first()
        return (
            reports.join(receipts.select("document", "admission"), "document")
            .select(
                "run", F.col("document").alias("source"), "admission", "coverage",
                *(F.lit(corpus[n]).alias(f"corpus_{n}") for n in ("concepts", "claims", "citations")), "refused", "repeated", "merged", "closed",
                F.lit(self.kept()).alias("documents"), F.lit(self.kept()).alias("knowledge"), "refusal", "needs",
            )
        )

    def _keep_coverage(self, reports: DataFrame, protocol: str, name: str, at: int | None) -> None:
        """Append what each admission did; earlier records stay."""
        found = F.when(F.col("coverage") == "yielded", F.col("citations")).otherwise(F.col("readings"))
        rows = with_positions(reports.select("run", "document", "coverage", "needs", found.alias("amount")), ["run", "document"])
        self.coverage.append(rows.select(
            (F.col("position") + F.lit(self.coverage.last())).alias("seq"), "run", "document", F.lit(protocol).alias("protocol"),
            F.lit(name).alias("reader"), F.col("coverage").alias("outcome"), "amount", "needs", F.lit(at).cast("long").alias("at"),
        ))

    def _keep_lineage(self, facts: DataFrame) -> None:
        columns = ["assertion", "document", "passage", "location", "protocol", "reader"]
        self._append_lineage(with_positions(facts.select(*columns), columns))

    def _append_lineage(self, rows: DataFrame) -> None:
        columns = ["assertion", "document", "passage", "location", "protocol", "reader"]
        self.readings.append(rows.select((F.col("position") + F.lit(self.readings.last())).alias("seq"), *columns))

    def _close(self, name: str, because: str, into: str | None, merging: bool, at: int | None) -> DataFrame:
        asked = self.spark.createDataFrame([(name, into, because, merging)], closing.CLOSINGS)
        judged = closing.verdicts(asked, self.graph())
        row = judged.first()
        if row.refusal is not None:
            raise Refused(row.refusal)
        self._append(closing.publications(judged, self._last() + 1, at))
        after = history.counts(self.log())
        return after.select(F.lit(name).alias("closed"), F.col("concepts").alias("current"), "held")

    def retire(self, name: str, because: str, at: int | None = None) -> DataFrame:
        return self._close(name, because, None, False, at)

    def supersede(self, name: str, into: str, because: str, at: int | None = None) -> DataFrame:
        return self._close(name, because, into, True, at)

    def reopen(self, name: str, because: str, at: int | None = None) -> DataFrame:
        """Make a closed concept current again, in a workspace that allows it."""
        if not self.reopening:
            raise Refused(NO_REOPENING)
        judged = closing.reopenings(self.spark.createDataFrame([(name, because)], "name string, because string"), self.graph())
        refusal = judged.first().refusal
        if refusal is not None:
            raise Refused(refusal)
        self._append(closing.reopened(judged, self._last() + 1, at))
        after = history.counts(self.log())
        return after.select(F.lit(name).alias("reopened"), F.col("concepts").alias("current"), "held")

    def history(self, through: int | None = None, as_of: int | None = None) -> DataFrame:
        """Counts of the whole log, of its first ``through`` records, or as of a time."""
        if through is not None and as_of is not None:
            raise Refused(TWO_QUESTIONS)
        log = self.log()
        if through is not None:
            log = history.through(log, through)
        elif as_of is not None:
            log = history.as_of(log, as_of)
        of = self._last()
        return history.counts(log).withColumns({"through": F.lit(log.count()), "of": F.lit(of)})

    def ask(self, tool: str, argument: str = "") -> str:
        """One tool's answer as text."""
        return tools.rendered(tools.answer(self.graph(), tool, argument))
