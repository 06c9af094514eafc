"""Readers: what turns a document's text into proposals, and what it cost.

A reader only proposes.  It mints no identity, writes nothing and decides nothing;
an answer it could not get is a refusal and never an empty reading.  Answers are
recorded and joined by the fingerprint of their request, so a plan never calls a
model from a task that may run twice; ``read_with`` is the door for readers that
are functions of the text.

Readings: ``document, passage, location, protocol, reader`` and ``proposed``, an
array of ``concept_name, claim_text``; where a reader names its document itself,
``asked`` is the one it was handed.  Refusals: ``document, refusal, needs``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelae.functions.identity import Derivation, is_identity
from stelae.functions.normalize import CONTROLS, normalized
from stelae.functions.values import fields_of, joined, optional_number, parsed_count, rendered_optional
from stelae.operators.ordered import previous, running

# Bounds and roles of a request.
MOST_PROPOSITIONS = 32
OUTPUT_TOKENS = 2_048
PASSAGE_CHARACTERS = 4_000
ROLE = "extractor"
TEXT, VISUAL = "text", "visual"
OUTCOMES = ("answered", "malformed", "abandoned", "budget-exhausted")
#: What each refusal lacks.
CANNOT_READ, NOT_READ, READER_FAILED = "cannot read", "not read", "reader failed"
PREREQUISITES = {
    CANNOT_READ: "a reading this extractor cannot do",
    NOT_READ: "a reader",
    READER_FAILED: "an answer from the reader",
}
NO_READING = "the reader returned no reading"
#: The shape an answer must have; a request carries it and ``answer_fault`` checks it.
ANSWER_SCHEMA = {
    "title": "propositions",
    "type": "array",
    "maxItems": MOST_PROPOSITIONS,
    "items": {
        "type": "object",
        "properties": {"concept": {"type": "string"}, "claim": {"type": "string"}},
        "required": ["concept", "claim"],
    },
}
PROPOSED = "array<struct<concept_name:string,claim_text:string>>"
READINGS = f"document string, passage int, location string, protocol string, reader string, proposed {PROPOSED}"
#: What a reader gave for each document it was handed: readings, or a refusal.
ANSWERS = f"asked string, {READINGS}, refusal string"


class CannotRead(ValueError):
    """A reader raises this for a source that is not of a kind it reads."""


class Reading(NamedTuple):
    """What a reader proposes of one passage: the document it read, where, and pairs of
    concept and claim in order."""

    document: str
    location: str
    proposed: list[tuple[str, str]]


def needs(refusal: Column) -> Column:
    return F.create_map(*(F.lit(x) for item in PREREQUISITES.items() for x in item))[refusal]


def passages(documents: DataFrame, floor: int = 1) -> DataFrame:
    """``document, passage, location, text, readable``: one passage per document.

    A text file is one page and a page is never split, so the size of a passage is
    a soft target.  A document that is no UTF-8 has a null text, and one with
    fewer characters than ``floor`` needs a picture of its page: both are not
    ``readable``.
    """
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    return documents.select(
        "document",
        F.lit(1).alias("passage"),
        F.format_string("pages %d to %d of the text", F.lit(1), F.lit(1)).alias("location"),
        text.alias("text"),
        F.coalesce(F.char_length(F.trim(text)) >= floor, F.lit(False)).alias("readable"),
    )


def fingerprint(model: str, instructions: str, passage: Column) -> Column:
    """What identifies a request: model, role, instructions, bounds and passage."""
    return (
        Derivation("request")
        .text("model", F.lit(model))
        .text("role", F.lit(ROLE))
        .text("instructions", F.lit(instructions))
        .text("most", F.lit(str(MOST_PROPOSITIONS)))
        .text("tokens", F.lit(str(OUTPUT_TOKENS)))
        .octets("passage", F.encode(passage, "UTF-8"))
        .seal()
    )


def requests(parts: DataFrame, model: str, instructions: str) -> DataFrame:
    """``document, passage, fingerprint, request``: what is asked of every readable passage,
    one block of content each."""
    return parts.filter("readable").select(
        "document", "passage", fingerprint(model, instructions, F.col("text")).alias("fingerprint"),
        F.struct(
            F.lit(model).alias("model"), F.lit(ROLE).alias("role"), F.lit(instructions).alias("instructions"),
            F.lit(json.dumps(ANSWER_SCHEMA)).alias("schema"), F.lit(OUTPUT_TOKENS).alias("output_tokens"), F.col("text").alias("content"),
        ).alias("request"),
    )


def protocol_identity(instructions: str, schema: str | None = None) -> Column:
    """Version of a protocol: its instructions, schema and budgets, not its model."""
    return (
        Derivation("protocol")
        .text("instructions", F.lit(instructions))
        .text("schema", F.lit(json.dumps(ANSWER_SCHEMA) if schema is None else schema))
        .text("most", F.lit(str(MOST_PROPOSITIONS)))
        .text("tokens", F.lit(str(OUTPUT_TOKENS)))
        .text("passage", F.lit(str(PASSAGE_CHARACTERS)))
        .excluding("model", "another model under one protocol is comparable")
        .seal()
    )


def _is_text(element: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(element, f"$.{name}", "variant")) == "STRING"


def answer_fault(answer: Column) -> Column:
    """Why a recorded JSON answer is no list of propositions; null if it is one.

    Types are looked at before any conversion, since a conversion would turn a
    wrong type into text or null.
    """
    value = F.try_parse_json(answer)
    items = F.try_variant_get(value, "$", "array<variant>")
    both = F.forall(items, lambda e: F.coalesce(_is_text(e, "concept") & _is_text(e, "claim"), F.lit(False)))
    return (
        F.when(answer.isNull(), F.lit("no answer"))
        .when(value.isNull(), F.lit("not JSON"))
        .when(items.isNull(), F.lit("not a sequence"))
        .when(F.size(items) > MOST_PROPOSITIONS, F.lit("too many propositions"))
        .when(~both, F.lit("a proposition lacks a text field"))
    )


def propositions(answer: Column) -> Column:
    """The propositions of an answer without fault."""
    items = F.try_variant_get(F.try_parse_json(answer), "$", "array<variant>")
    return F.transform(
        items,
        lambda e: F.struct(
            F.try_variant_get(e, "$.concept", "string").alias("concept_name"),
            F.try_variant_get(e, "$.claim", "string").alias("claim_text"),
        ),
    )


def recorded_readings(
    parts: DataFrame, recordings: DataFrame, model: str, instructions: str, protocol: str, needed: str = TEXT
) -> tuple[DataFrame, DataFrame]:
    """Readings and refusals from recorded answers (``fingerprint, answer``).

    One passage that cannot be read, or has no or a malformed answer, refuses its
    whole document.  Answers to text requests are no visual reading: where one is
    ``needed`` nothing can be read.
    """
    if needed != TEXT:
        parts = parts.withColumn("readable", F.lit(False))
    asked = parts.withColumn("fingerprint", fingerprint(model, instructions, F.coalesce("text", F.lit(""))))
    answered = asked.join(recordings.select("fingerprint", "answer"), "fingerprint", "left").withColumn(
        "fault",
        F.when(~F.col("readable"), F.lit(CANNOT_READ)).when(answer_fault(F.col("answer")).isNotNull(), F.lit(READER_FAILED)),
    )
    worst = answered.groupBy("document").agg(F.min("fault").alias("refusal"))
    kept = answered.join(worst.filter(F.col("refusal").isNull()).select("document"), "document", "left_semi")
    readings = kept.select(
        "document", "passage", normalized(F.col("location")).alias("location"),
        normalized(F.lit(protocol)).alias("protocol"), normalized(F.lit(model)).alias("reader"),
        propositions(F.col("answer")).alias("proposed"),
    )
    refused = worst.filter(F.col("refusal").isNotNull())
    return readings, refused.select("document", "refusal", needs(F.col("refusal")).alias("needs"))


def stated_readings(said: DataFrame, protocol: str = "stated", reader: str = "a person") -> DataFrame:
    """One reading per document from ``document, location, ordinal, concept_name,
    claim_text``: what a person says of it, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "concept_name", "claim_text")))
    return (
        said.groupBy("document")
        .agg(pairs.alias("_said"), F.min("location").alias("location"))
        .select(
            "document", F.lit(1).alias("passage"), normalized(F.col("location")).alias("location"),
            F.lit(protocol).alias("protocol"), F.lit(reader).alias("reader"),
            F.transform("_said", lambda s: F.struct(s["concept_name"].alias("concept_name"), s["claim_text"].alias("claim_text"))).alias("proposed"),
        )
    )


def read_with(
    reader: Callable[[str, bytes, str], list[Reading]], documents: DataFrame, protocol: str, name: str, needed: str = TEXT
) -> DataFrame:
    """``ANSWERS`` of a Python function of a document's address, its octets and the kind of
    reading needed, batch by batch: one row per reading, or one with a refusal.

    ``CannotRead`` and any other exception of the reader refuse that document and no
    other.  The function must give the same answer when it is asked twice.
    """

    def rows(document: str, content: bytes) -> list[tuple]:
        try:
            found = [Reading(*r) for r in reader(document, bytes(content), needed)]
            pairs = [[{"concept_name": c, "claim_text": t} for c, t in r.proposed] for r in found]
        except CannotRead:
            return [(document, document, None, None, protocol, name, None, CANNOT_READ)]
        except Exception:  # whatever a reader does, it is a fact about one source
            return [(document, document, None, None, protocol, name, None, READER_FAILED)]
        return [(document, r.document, n, r.location, protocol, name, p, None) for n, (r, p) in enumerate(zip(found, pairs), 1)]

    columns = [c.split()[0] for c in ANSWERS.replace(PROPOSED, "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answered = [r for d, o in zip(frame["document"], frame["content"]) for r in rows(d, o)]
            out = pd.DataFrame(answered, columns=columns)
            yield out.astype({"passage": "Int32"})

    return documents.select("document", "content").mapInPandas(run, ANSWERS)


def answered(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings (with ``asked``) and refusals of ``ANSWERS``."""
    given = answers.filter("refusal IS NULL").drop("refusal")
    refused = answers.filter("refusal IS NOT NULL").select(F.col("asked").alias("document"), "refusal")
    return given, refused.distinct().withColumn("needs", needs(F.col("refusal")))


def misdirected(readings: DataFrame) -> DataFrame:
    """Handed documents (``asked``) of which a reading names another document."""
    return readings.filter(~F.col("asked").eqNullSafe(F.col("document"))).select("asked").distinct()


def examined(documents: DataFrame, readings: DataFrame | None = None, refusals: DataFrame | None = None) -> DataFrame:
    """``document, readings, refusal, needs``: what came of reading every handed document.

    No reader (``readings`` None) leaves every document not read.  A refusal, or one
    misdirected reading, refuses the whole document, which then counts no readings; a
    document without any reading has no refusal, and needs one all the same.
    """
    handed = documents.select("document").distinct()
    none = F.lit(0).cast("long")
    if readings is None:
        refusal = F.lit(NOT_READ)
        return handed.select("document", none.alias("readings"), refusal.alias("refusal"), needs(refusal).alias("needs"))
    asked = F.col("asked") if "asked" in readings.columns else F.col("document")
    given = readings.groupBy(asked.alias("document")).agg(
        F.count("*").alias("_given"), F.max(~asked.eqNullSafe(F.col("document"))).alias("_astray")
    )
    joined = handed.join(given, "document", "left")
    if refusals is None:
        joined = joined.withColumn("_refused", F.lit(None).cast("string"))
    else:
        joined = joined.join(refusals.groupBy("document").agg(F.min("refusal").alias("_refused")), "document", "left")
    refusal = F.coalesce("_refused", F.when(F.col("_astray"), F.lit(READER_FAILED)))
    counted = joined.select(
        "document", F.when(refusal.isNull(), F.coalesce("_given", none)).otherwise(none).alias("readings"), refusal.alias("refusal")
    )
    lacking = F.when(F.col("refusal").isNotNull(), needs(F.col("refusal"))).when(F.col("readings") == 0, F.lit(NO_READING))
    return counted.withColumn("needs", lacking)


def accepted(readings: DataFrame, outcome: DataFrame) -> DataFrame:
    """The readings of documents that ``examined`` does not refuse."""
    return readings.join(outcome.filter("refusal IS NULL").select("document"), "document", "left_semi")


def lineage(readings: DataFrame, scope: Column | None = None) -> DataFrame:
    """``assertion, document, passage, location, protocol, reader``: every reading as a fact
    of its own about each assertion it makes, never a part of the assertion's identity."""
    from stelae.operators.admission import linked

    said = readings.select(
        F.lit(0).cast("long").alias("run"), "document", (F.lit("") if scope is None else scope).alias("scope"), "passage",
        "location", "protocol", "reader", F.posexplode("proposed").alias("ordinal", "_p"),
    )
    flat = said.select("*", F.col("_p.concept_name").alias("concept_name"), F.col("_p.claim_text").alias("claim_text"))
    carried = flat.withColumn("_lineage", F.struct("passage", "location", "protocol", "reader"))
    made = linked(carried, "_lineage").filter("complete")
    return made.select("assertion", "document", "_lineage.*").distinct()


def statements(readings: DataFrame, runs: DataFrame, scope: Column | None = None) -> DataFrame:
    """Readings flattened to ``admission.STATEMENTS``, their order kept."""
    return (
        readings.join(runs.select("run", "document"), "document")
        .select("run", "document", "passage", F.posexplode("proposed").alias("ordinal", "_p"))
        .select(
            "run", "document", (F.lit("") if scope is None else scope).alias("scope"), "passage", "ordinal",
            F.col("_p.concept_name").alias("concept_name"), F.col("_p.claim_text").alias("claim_text"),
        )
    )


def outcomes(requests: DataFrame, ceiling: int) -> DataFrame:
    """Requests of a source with their running cost and ``judged`` outcome.

    ``requests``: ``document``, ``passage`` (its order), ``answered``,
    ``well_formed``, ``cost_micros``.  The ceiling is over one source and looked
    at before and after each request, so a request whose cost reaches it is
    exhausted and so is every later one.
    """
    spent = running(requests, "document", "passage", F.coalesce("cost_micros", F.lit(0)), "spent")
    judged = (
        F.when(F.col("spent") >= ceiling, F.lit("budget-exhausted"))
        .when(F.col("answered") & F.col("well_formed"), F.lit("answered"))
        .when(F.col("answered"), F.lit("malformed"))
        .otherwise(F.lit("abandoned"))
    )
    return spent.withColumn("judged", judged)


def retried(attempts: DataFrame, most: int) -> DataFrame:
    """``document, passage, failed, answered, answer`` of ``document, passage, attempt, answer``:
    each request is asked until an answer has no fault, ``most`` times at most; what
    would have come later was never asked."""
    judged = attempts.filter(F.col("attempt").between(1, most)).withColumn("ok", answer_fault(F.col("answer")).isNull())
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    answer = F.min_by("answer", F.when(F.col("ok"), F.col("attempt")))
    asked = judged.groupBy("document", "passage").agg(first.alias("_first"), F.max("attempt").alias("_made"), answer.alias("answer"))
    return asked.select(
        "document", "passage", F.coalesce(F.col("_first") - 1, "_made").cast("long").alias("failed"),
        F.col("_first").isNotNull().cast("int").alias("answered"), F.when(F.col("_first").isNotNull(), F.col("answer")).alias("answer"),
    )


def priced(usage: DataFrame, card: dict[str, int]) -> DataFrame:
    """``usage`` with ``cost_micros`` by a card of micros per million tokens of each kind,
    rounded down once; a count that was not reported leaves the cost absent."""
    cost = sum((F.col(kind) * F.lit(rate) for kind, rate in card.items()), F.lit(0).cast("long"))
    return usage.withColumn("cost_micros", cost).withColumn("cost_micros", F.expr("cost_micros div 1000000"))


def measures(ledger: DataFrame, priced: bool = True) -> DataFrame:
    """Per-request usage from a running ledger of ``document, passage, failed,
    answered`` and running ``input, output, cost_micros``.

    Usage and cost are absent where nothing was answered, cost also without a
    price card; an absent value stays absent and is never 0.
    """
    counters = ["input", "output", "cost_micros"]
    seen = previous(ledger, "document", "passage", F.struct(*counters), "_seen")
    delta = lambda c: F.greatest(F.col(c) - F.coalesce(F.col("_seen")[c], F.lit(0)), F.lit(0))
    used = F.col("answered") == 1
    return seen.select(
        "document", "passage", (F.col("failed") + F.col("answered")).alias("attempts"),
        F.when(used, delta("input")).alias("input"), F.when(used, delta("output")).alias("output"),
        (F.when(used, delta("cost_micros")) if priced else F.lit(None).cast("long")).alias("cost_micros"),
    )


CALL_FIELDS = (
    "role", "model", "protocol", "document", "outcome", "attempts", "input", "output", "cache_read", "cache_write",
    "cost_micros", "wait_nanos",
)
CALL_VERSION = "call-v1"
# Why a call record is not read.
FIELD_COUNT, VERSION_FAULT, TEXT_FAULT = "wrong field count", "unsupported version", "empty or control-bearing text"
COUNT_FAULT, WAIT_FAULT, SOURCE_FAULT = "invalid unsigned count", "invalid wait", "invalid source identity"
OUTCOME_FAULT, USAGE_FAULT = "unknown outcome", "partial token counts"


def _usable(text: Column) -> Column:
    return F.coalesce((text != "") & ~text.rlike(CONTROLS) & ~text.rlike(r"[\x{9}-\x{D}\x{85}]"), F.lit(False))


def rendered_calls(calls: DataFrame, version: str = CALL_VERSION) -> DataFrame:
    """``call_id, record, fault``: call records as text; a record that cannot be
    written has a fault and no text."""
    usage = [F.col(c) for c in ("input", "output", "cache_read", "cache_write")]
    some = sum((c.isNotNull().cast("int") for c in usage), F.lit(0))
    fault = F.when(
        ~(_usable(F.col("role")) & _usable(F.col("model")) & _usable(F.col("protocol"))), F.lit(TEXT_FAULT)
    ).when((some > 0) & (some < 4), F.lit(USAGE_FAULT))
    fields = [F.lit(version), *(F.col(c) for c in CALL_FIELDS[:5]), F.col("attempts").cast("string")]
    fields += [rendered_optional(c) for c in (*usage, F.col("cost_micros"))] + [F.col("wait_nanos").cast("string")]
    record = joined(*(F.coalesce(f, F.lit("")) for f in fields))
    return calls.select("call_id", F.when(fault.isNull(), record).alias("record"), fault.alias("fault"))


def parsed_calls(records: DataFrame, version: str = CALL_VERSION) -> DataFrame:
    """``call_id``, the call's fields and ``fault`` from ``call_id, record``."""
    split = records.filter(F.col("record").isNotNull()).select("call_id", fields_of(F.col("record")).alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    usage = [get(i) for i in range(7, 11)]
    absent = sum(((c == "-").cast("int") for c in usage), F.lit(0))
    unsigned = lambda c: F.coalesce(parsed_count(c).isNotNull(), F.lit(False))
    counted = lambda c: (c == "-") | unsigned(c)
    fault = (
        F.when(F.size("f") != 13, F.lit(FIELD_COUNT))
        .when(get(0) != version, F.lit(VERSION_FAULT))
        .when(~(_usable(get(1)) & _usable(get(2)) & _usable(get(3))), F.lit(TEXT_FAULT))
        .when(~unsigned(get(6)) | ~counted(usage[0]) | ~counted(usage[1]) | ~counted(usage[2]) | ~counted(usage[3]) | ~counted(get(11)), F.lit(COUNT_FAULT))
        .when((absent > 0) & (absent < 4), F.lit(USAGE_FAULT))
        .when(~F.coalesce(get(12).rlike(r"^[0-9]+\z"), F.lit(False)), F.lit(WAIT_FAULT))
        .when(~is_identity(get(4)), F.lit(SOURCE_FAULT))
        .when(~get(5).isin(*OUTCOMES), F.lit(OUTCOME_FAULT))
    )
    values = [get(1), get(2), get(3), get(4), get(5), parsed_count(get(6)), *(optional_number(c) for c in usage), optional_number(get(11)), get(12).try_cast("decimal(38,0)")]
    return split.select(
        "call_id", *(F.when(fault.isNull(), v).alias(n) for n, v in zip(CALL_FIELDS, values)), fault.alias("fault")
    )


def grounded(proposals: DataFrame) -> DataFrame:
    """Proposals (``quote``, ``passage_text``) whose quote stands in its passage, both
    normalized; a blank quote grounds nothing."""
    quote = normalized(F.coalesce("quote", F.lit("")))
    return proposals.withColumn(
        "grounded", (quote != "") & normalized(F.coalesce("passage_text", F.lit(""))).contains(quote)
    )
