"""Queries of call records, budgets, recorded answers and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions.identity import document_identity, document_sql
from stelae.functions.normalize import normalized_sql
from stelae.operators import audit, reading
from stelae.operators.ordered import running
from stelae.sources.tables import table

_CEILING = 200_000


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every call once; deliveries of one call have the same content."""
    rows = table(spark, folder, "call_records").drop("loaded_at")
    return rows.dropDuplicates(["call_id"])


def call_record_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Call records written as text and read again."""
    written = reading.rendered_calls(calls(spark, folder))
    return reading.parsed_calls(written).select(
        "call_id", "role", "model", "protocol", "document", "outcome",
        *(F.col(c).cast("string").alias(c) for c in reading.CALL_FIELDS[5:]), "fault",
    )


def call_record_faults(spark: SparkSession, folder: str) -> DataFrame:
    written = reading.rendered_calls(calls(spark, folder))
    read = reading.parsed_calls(written).select("call_id", F.col("fault").alias("read_fault"))
    why = F.coalesce("fault", "read_fault", F.lit("none"))
    return written.join(read, "call_id", "left").groupBy(why.alias("fault")).agg(F.count("*").alias("records"))


def call_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes under a ceiling of cost per document, requests in order of call."""
    requests = calls(spark, folder).filter("call_id IS NOT NULL").select(
        "document", F.col("call_id").alias("passage"), F.coalesce(F.col("outcome").isin("answered", "malformed"), F.lit(False)).alias("answered"),
        F.coalesce(F.col("outcome") == "answered", F.lit(False)).alias("well_formed"), "cost_micros",
    )
    return reading.outcomes(requests, _CEILING).select("document", F.col("passage").alias("call_id"), "spent", "judged")


def call_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage per request, as differences of a running ledger per document."""
    rows = calls(spark, folder).filter("call_id IS NOT NULL").select(
        "document", F.col("call_id").alias("passage"), F.lit(0).alias("failed"),
        F.coalesce(F.col("outcome").isin("answered", "malformed"), F.lit(False)).cast("int").alias("answered"),
        "input", "output", "cost_micros",
    )
    for c in ("input", "output", "cost_micros"):
        rows = running(rows, "document", "passage", F.coalesce(c, F.lit(0)), f"_{c}").drop(c).withColumnRenamed(f"_{c}", c)
    return reading.measures(rows).withColumnRenamed("passage", "call_id")


_CARD = {"input": 3_000_000, "output": 15_000_000, "cache_read": 300_000, "cache_write": 3_750_000}


def call_prices(spark: SparkSession, folder: str) -> DataFrame:
    """What every call would cost by a price card; nothing where a count was not reported."""
    usage = calls(spark, folder).filter("call_id IS NOT NULL").select("call_id", *_CARD)
    return reading.priced(usage, _CARD).select("call_id", "cost_micros")


def retried_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every call asked as often as it says, three times at most; an answered one is answered at its last attempt."""
    rows = calls(spark, folder).filter("call_id IS NOT NULL AND attempts BETWEEN 1 AND 64")
    tried = rows.select("document", F.col("call_id").alias("passage"), "outcome", "attempts", F.explode(F.sequence(F.lit(1).cast("long"), "attempts")).alias("attempt"))
    good = (F.col("outcome") == "answered") & (F.col("attempt") == F.col("attempts"))
    answers = tried.withColumn("answer", F.when(good, F.lit("[]")).otherwise(F.lit("{")))
    return reading.retried(answers, 3).select(F.col("passage").alias("call_id"), "failed", "answered")


def visual_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """No source can be read where a picture is needed and only texts were asked."""
    sources = table(spark, folder, "sources").select("document", "content").dropDuplicates(["document"])
    none = spark.createDataFrame([], "fingerprint string, answer string")
    return reading.recorded_readings(reading.passages(sources), none, "a model", "", "p", needed=reading.VISUAL)[1]


def source_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all sources, and which can be read as text."""
    sources = table(spark, folder, "sources").select("document", "content").dropDuplicates(["document"])
    parts = reading.passages(sources)
    return parts.select("document", "passage", "location", "readable", F.octet_length("text").cast("long").alias("octets"))


def reading_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "sources").select("document", "content").dropDuplicates(["document"])
    by = audit.by_fidelity(reading.passages(sources))
    return by.groupBy(F.coalesce("coverage", F.lit("read")).alias("coverage")).agg(F.count("*").alias("documents"))


def recorded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of answers: each claim row's text and concept as a recorded answer, some
    of them of a wrong shape by their key's last digit."""
    rows = table(spark, folder, "claims").select("claim", "concept", "text").distinct()
    last = F.substring("claim", 64, 1)
    fields = F.struct(F.coalesce("concept", F.lit("")).alias("concept"), F.coalesce("text", F.lit("")).alias("claim"))
    answer = (
        F.when(last == "0", F.to_json(fields))
        .when(last == "1", F.lit("12"))
        .when(last == "2", F.to_json(F.array(F.struct(F.lit("x").alias("concept")))))
        .when(last == "3", F.to_json(F.array(F.struct(F.lit(7).alias("concept"), F.lit("y").alias("claim")))))
        .when(last == "4", F.lit("not json"))
        .when(last == "5", F.lit("[]"))
        .when(last == "6", F.to_json(F.array_repeat(fields, 33)))
        .when(last == "7", F.lit(None).cast("string"))
        .otherwise(F.to_json(F.array(fields)))
    )
    judged = rows.select(reading.answer_fault(answer).alias("fault"), F.size(reading.propositions(answer)).alias("n"))
    return judged.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(
        F.count("*").alias("answers"), F.sum(F.when(F.col("fault").isNull(), F.col("n")).otherwise(0)).alias("propositions")
    )


def grounded_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """The last word of every claim's text as a quote from the names of its concept's rows."""
    concepts = table(spark, folder, "concepts").select("concept", F.col("canonical_name").alias("passage_text")).distinct()
    last_word = F.element_at(F.split(F.coalesce("text", F.lit("")), " ", -1), -1)
    quotes = table(spark, folder, "claims").select("claim", "concept", F.regexp_replace(last_word, r"\.$", "").alias("quote")).distinct()
    return reading.grounded(quotes.join(concepts, "concept")).select("claim", "quote", "passage_text", "grounded")


def grounded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every claim's whole text as a quote from the names of its concept's rows; without such a row it is not grounded."""
    concepts = table(spark, folder, "concepts").select("concept", F.col("canonical_name").alias("passage_text")).distinct()
    quotes = table(spark, folder, "claims").select("claim", "concept", F.coalesce("text", F.lit("")).alias("quote")).distinct()
    return reading.grounded(quotes.join(concepts, "concept", "left")).select("claim", "quote", "passage_text", "grounded")


def source_files_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Octets, and not characters, of every stored source."""
    rows = table(spark, folder, "sources").filter("content IS NOT NULL")
    return rows.select(document_identity(F.col("content")).alias("document"), F.octet_length("content").cast("long").alias("octets")).distinct()


QUERIES = {
    q.__name__: q
    for q in (
        call_record_codec, call_record_faults, call_budget, call_usage, call_prices, retried_calls, visual_refusals, source_passages, reading_fidelity, recorded_answers,
        grounded_quotes, grounded_texts, source_files_identity,
    )
}

_CALLS = "calls AS (SELECT * EXCLUDE (loaded_at) FROM call_records QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY loaded_at) = 1)"
_SOME = "((input IS NOT NULL)::INT + (output IS NOT NULL)::INT + (cache_read IS NOT NULL)::INT + (cache_write IS NOT NULL)::INT)"
_TEXT_OK = " AND ".join(f"coalesce(regexp_full_match({c}, '[^\\x00-\\x1f\\x7f-\\x9f]+'), false)" for c in ("role", "model", "protocol"))
_FAULT = f"""CASE WHEN NOT ({_TEXT_OK}) THEN 'empty or control-bearing text'
  WHEN {_SOME} BETWEEN 1 AND 3 THEN 'partial token counts' END"""
_READ_FAULT = """CASE WHEN NOT coalesce(regexp_full_match(attempts::VARCHAR, '[0-9]+'), false) OR input < 0 OR output < 0 OR cache_read < 0 OR cache_write < 0 OR cost_micros < 0 THEN 'invalid unsigned count'
  WHEN NOT coalesce(wait_nanos >= 0, false) THEN 'invalid wait'
  WHEN NOT coalesce(regexp_full_match(document, '[0-9a-f]{64}'), false) THEN 'invalid source identity'
  WHEN NOT coalesce(outcome IN ('answered', 'malformed', 'abandoned', 'budget-exhausted'), false) THEN 'unknown outcome' END"""
_FIELDS = ", ".join(
    f"CASE WHEN read_fault IS NULL THEN {c}{'::VARCHAR' if n >= 5 else ''} END AS {c}" for n, c in enumerate(reading.CALL_FIELDS)
)

_PASSAGES = """passages AS (SELECT document, TRY(decode(content)) AS text FROM sources QUALIFY row_number() OVER (PARTITION BY document) = 1),
judged AS (SELECT document, text, coalesce(length(trim(text, ' ')) >= 1, false) AS readable FROM passages)"""

ORACLE = {
    "source_passages": f"""WITH {_PASSAGES} SELECT document, 1 AS passage, 'pages 1 to 1 of the text' AS location, readable,
  strlen(text)::BIGINT AS octets FROM judged""",
    "reading_fidelity": f"WITH {_PASSAGES} SELECT CASE WHEN readable THEN 'read' ELSE 'unmet' END AS coverage, count(*) AS documents FROM judged GROUP BY 1",
    "call_record_codec": f"""WITH {_CALLS}, judged AS (SELECT *, {_FAULT} AS write_fault, {_READ_FAULT} AS read_fault FROM calls)
SELECT call_id, {_FIELDS}, read_fault AS fault FROM judged WHERE write_fault IS NULL""",
    "call_record_faults": f"""WITH {_CALLS} SELECT coalesce({_FAULT}, {_READ_FAULT}, 'none') AS fault, count(*) AS records FROM calls GROUP BY 1""",
    "call_budget": f"""WITH {_CALLS}, s AS (SELECT document, call_id, outcome,
  sum(coalesce(cost_micros, 0)) OVER (PARTITION BY document ORDER BY call_id) AS spent FROM calls WHERE call_id IS NOT NULL)
SELECT document, call_id, spent::BIGINT AS spent, CASE WHEN spent >= {_CEILING} THEN 'budget-exhausted'
  WHEN outcome = 'answered' THEN 'answered' WHEN outcome = 'malformed' THEN 'malformed' ELSE 'abandoned' END AS judged FROM s""",
    "call_usage": f"""WITH {_CALLS}, u AS (SELECT *, coalesce(outcome IN ('answered', 'malformed'), false) AS used FROM calls WHERE call_id IS NOT NULL)
SELECT document, call_id, used::INTEGER AS attempts, CASE WHEN used THEN coalesce(input, 0) END AS input,
  CASE WHEN used THEN coalesce(output, 0) END AS output, CASE WHEN used THEN coalesce(cost_micros, 0) END AS cost_micros FROM u""",
    "call_prices": f"""WITH {_CALLS} SELECT call_id, ({" + ".join(f"{k}::HUGEINT * {v}" for k, v in _CARD.items())})::BIGINT // 1000000 AS cost_micros
FROM calls WHERE call_id IS NOT NULL""",
    "retried_calls": f"""WITH {_CALLS} SELECT call_id, CASE WHEN outcome = 'answered' AND attempts <= 3 THEN attempts - 1 ELSE least(attempts, 3) END::BIGINT AS failed,
  coalesce(outcome = 'answered' AND attempts <= 3, false)::INTEGER AS answered FROM calls WHERE call_id IS NOT NULL AND attempts BETWEEN 1 AND 64""",
    "visual_refusals": """SELECT DISTINCT document, 'cannot read' AS refusal, 'a reading this extractor cannot do' AS needs FROM sources""",
    "recorded_answers": """WITH r AS (SELECT DISTINCT claim, concept, text FROM claims), j AS (SELECT CASE right(claim, 1)
  WHEN '0' THEN 'not a sequence' WHEN '1' THEN 'not a sequence' WHEN '2' THEN 'a proposition lacks a text field'
  WHEN '3' THEN 'a proposition lacks a text field' WHEN '4' THEN 'not JSON' WHEN '6' THEN 'too many propositions'
  WHEN '7' THEN 'no answer' ELSE 'none' END AS fault, CASE WHEN right(claim, 1) IN ('8','9','a','b','c','d','e','f') THEN 1 ELSE 0 END AS n FROM r)
SELECT fault, count(*) AS answers, sum(n)::BIGINT AS propositions FROM j GROUP BY 1""",
    "grounded_quotes": f"""WITH q AS (SELECT DISTINCT claim, concept, regexp_replace(string_split(coalesce(text, ''), ' ')[-1], '\\.$', '') AS quote FROM claims),
p AS (SELECT DISTINCT concept, canonical_name AS passage_text FROM concepts)
SELECT claim, quote, passage_text, {normalized_sql('quote')} <> '' AND contains({normalized_sql("coalesce(passage_text, '')")}, {normalized_sql('quote')}) AS grounded
FROM q JOIN p USING (concept)""",
    "grounded_texts": f"""WITH q AS (SELECT DISTINCT claim, concept, coalesce(text, '') AS quote FROM claims),
p AS (SELECT DISTINCT concept, canonical_name AS passage_text FROM concepts)
SELECT claim, quote, passage_text, {normalized_sql('quote')} <> '' AND contains({normalized_sql("coalesce(passage_text, '')")}, {normalized_sql('quote')}) AS grounded
FROM q LEFT JOIN p USING (concept)""",
    "source_files_identity": f"SELECT DISTINCT {document_sql('content')} AS document, octet_length(content)::BIGINT AS octets FROM sources WHERE content IS NOT NULL",
}
