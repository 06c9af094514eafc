"""Queries of the scalar functions: normalization, identities, records, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions import identity as i
from stelae.functions.normalize import has_all_words, normalized, normalized_sql, words_of
from stelae.functions.values import fields_of, joined, parsed_count, parsed_time
from stelae.sources.tables import table

_WORDS = "iron by"


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "concepts").select("concept", normalized(F.col("canonical_name")).alias("name")).distinct()


def normalize_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct normalized lines of all documents and how often each occurs."""
    lines = table(spark, folder, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy(normalized(F.col("line")).alias("line")).agg(F.count("*").alias("times"))


def document_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sources")
    return rows.select("document", i.document_identity(F.col("content")).alias("derived")).distinct()


def concept_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "concepts")
    return rows.select("concept", i.concept_identity(F.col("canonical_name")).alias("derived")).distinct()


def claim_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "claims").filter(i.is_identity(F.col("concept")))
    return rows.select("claim", i.claim_identity(F.col("concept"), F.col("text")).alias("derived")).distinct()


def assertion_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "assertions").filter(i.is_identity(F.col("claim")))
    derived = i.assertion_identity(F.col("claim"), F.coalesce("source", F.lit("")), F.coalesce("scope", F.lit("")))
    return rows.select("assertion", derived.alias("derived")).distinct()


def identity_parse_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "claims").select(F.col("concept").alias("reference"))
    both = refs.unionByName(table(spark, folder, "assertions").select(F.col("claim").alias("reference")))
    why = i.identity_refusal(F.col("reference"))
    return both.groupBy(F.coalesce(why, F.lit("an identity")).alias("verdict")).agg(F.count("*").alias("references"))


def words_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "claims").filter(F.col("text").isNotNull())
    text = normalized(F.col("text"))
    return rows.select("claim", text.alias("text")).distinct().filter(has_all_words(F.col("text"), words_of(_WORDS)))


def record_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Records joined by the separator and taken apart again."""
    rows = table(spark, folder, "publications").select("arrival", *(F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "standing", "ref", "text")))
    record = joined("kind", "standing", "ref", "text")
    fields = fields_of(F.col("record"))
    return rows.select("arrival", record.alias("record")).select(
        "arrival", F.size(fields).cast("long").alias("fields"), F.element_at(fields, -1).alias("last")
    )


def parsed_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """First words of all lines, read as a count and as a time."""
    lines = table(spark, folder, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    words = lines.select(F.substring_index(F.regexp_replace("line", "\r", ""), " ", 1).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("times")).select(
        "word", "times", parsed_count(F.col("word")).cast("string").alias("count"), parsed_time(F.col("word")).alias("time")
    )


QUERIES = {
    q.__name__: q
    for q in (
        normalize_names, normalize_lines, document_identity, concept_identity, claim_identity, assertion_identity,
        identity_parse_verdicts, words_match, record_fields, parsed_numbers,
    )
}

_HEX = "'^[0-9a-f]{64}$'"
_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"

ORACLE = {
    "normalize_names": f"SELECT DISTINCT concept, {normalized_sql('canonical_name')} AS name FROM concepts",
    "normalize_lines": f"SELECT {normalized_sql('line')} AS line, count(*) AS times FROM ({_LINES}) GROUP BY 1",
    "document_identity": f"SELECT DISTINCT document, {i.document_sql('content')} AS derived FROM sources",
    "concept_identity": f"SELECT DISTINCT concept, {i.concept_sql('canonical_name')} AS derived FROM concepts",
    "claim_identity": f"SELECT DISTINCT claim, {i.claim_sql('concept', 'text')} AS derived FROM claims WHERE regexp_full_match(concept, {_HEX})",
    "assertion_identity": f"""SELECT DISTINCT assertion,
  {i.assertion_sql('claim', "coalesce(source, '')", "coalesce(scope, '')")} AS derived
FROM assertions WHERE regexp_full_match(claim, {_HEX})""",
    "identity_parse_verdicts": """
SELECT CASE WHEN r IS NULL THEN 'absent' WHEN length(r) <> 64 THEN 'wrong length ' || length(r)
            WHEN regexp_matches(r, '[^0-9a-f]') THEN 'not a digit ' || regexp_extract(r, '([^0-9a-f])', 1)
            ELSE 'an identity' END AS verdict, count(*) AS "references"
FROM (SELECT concept AS r FROM claims UNION ALL SELECT claim FROM assertions) GROUP BY 1""",
    "words_match": f"""SELECT * FROM (SELECT DISTINCT claim, {normalized_sql('text')} AS text FROM claims WHERE text IS NOT NULL)
WHERE contains(text, 'iron') AND contains(text, 'by')""",
    "record_fields": """SELECT arrival, len(f)::BIGINT AS fields, f[-1] AS last FROM (
  SELECT arrival, string_split(concat_ws(chr(31), coalesce(kind, ''), coalesce(standing, ''), coalesce(ref, ''), coalesce(text, '')), chr(31)) AS f
  FROM publications)""",
    "parsed_numbers": f"""SELECT word, count(*) AS times,
  CASE WHEN regexp_full_match(word, '\\+?[0-9]+') AND length(ltrim(ltrim(word, '+'), '0')) <= 20 THEN TRY_CAST(word AS HUGEINT)::VARCHAR END AS count,
  CASE WHEN regexp_full_match(word, '[+-]?[0-9]+') THEN TRY_CAST(word AS BIGINT) END AS time
FROM (SELECT split_part(replace(line, chr(13), ''), ' ', 1) AS word FROM ({_LINES})) GROUP BY word""",
}
