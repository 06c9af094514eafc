"""Queries of admission, the document store and coverage.

Two views of the tables serve as input.  *Lines*: every line of a document is a
claim about the document's ``source``, in the scope of its ``lang``; a run is a
document row.  *Citations*: every assertion is a proposal of its claim's text
about its concept's name, made by its source; a run is a source on a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions import identity as i
from stelae.functions.normalize import normalized_sql
from stelae.operators import admission, audit
from stelae.operators.graph import KnowledgeGraph
from stelae.sources import content_store
from stelae.sources.tables import spread, table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text", "lang", "source"))
    addressed = documents.select(
        F.col("doc_id").alias("run"),
        i.document_identity(F.encode("text", "UTF-8")).alias("document"),
        F.col("lang").alias("scope"),
        F.lit(1).alias("passage"),
        F.col("source").alias("concept_name"),
        "text",
    )
    return addressed.select(
        "run", "document", "scope", "passage", "concept_name", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "claim_text")
    )


def _graph(spark: SparkSession, folder: str) -> KnowledgeGraph:
    return KnowledgeGraph.of_tables(*(table(spark, folder, n) for n in ("concepts", "claims", "assertions")))


def _citations(spark: SparkSession, folder: str) -> DataFrame:
    held = _graph(spark, folder)
    made = table(spark, folder, "assertions").select(
        F.coalesce(F.floor(F.col("at_seconds") / 86400), F.lit(-1)).alias("run"),
        F.coalesce("source", F.lit("")).alias("document"), "scope", "claim", F.lit(1).alias("passage"), F.lit(0).alias("ordinal"),
    )
    named = held.claims.select("claim", "concept", F.col("text").alias("claim_text")).join(
        held.concepts.select("concept", F.col("canonical_name").alias("concept_name")), "concept"
    )
    return made.join(named, "claim").drop("claim", "concept")


def corroborated_claims(spark: SparkSession, folder: str) -> DataFrame:
    return admission.corroborated(_lines(spark, folder))


def admission_report(spark: SparkSession, folder: str) -> DataFrame:
    return admission.report(_lines(spark, folder))


def admission_into_known(spark: SparkSession, folder: str) -> DataFrame:
    return admission.report(_citations(spark, folder), known=_graph(spark, folder)).select(
        "run", "document", "concepts", "claims", "citations", "repeated", "merged", "closed"
    )


def admission_publications(spark: SparkSession, folder: str) -> DataFrame:
    return admission.publications(_lines(spark, folder)).select("run", "rank", "kind", "id", "ref", "text", "source", "scope")


def publications_into_known(spark: SparkSession, folder: str) -> DataFrame:
    published = admission.publications(_citations(spark, folder), _graph(spark, folder))
    return published.groupBy("run", "kind").agg(F.count("*").alias("records"), F.min("id").alias("least"))


def repeated_citations(spark: SparkSession, folder: str) -> DataFrame:
    again = admission.repeats(admission.linked(_lines(spark, folder)))
    return again.select("run", "ordinal", "assertion")


def coverage_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Runs per source and coverage, runs without any reading included."""
    rows = table(spark, folder, "documents")
    runs = rows.select(
        F.col("doc_id").alias("run"), i.document_identity(F.encode("text", "UTF-8")).alias("document"), "source"
    )
    found = admission.report(_lines(spark, folder)).select("run", "coverage")
    covered = runs.join(found, "run", "left").withColumn("coverage", F.coalesce("coverage", F.lit("unmet")))
    return covered.groupBy("source", "coverage").agg(F.count("*").alias("runs"))


def store_admissions(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "assertions").select(F.col("source").alias("document"))
    return content_store.admissions(table(spark, folder, "sources"), held)


def document_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.encode("text", "UTF-8").alias("content"))
    return content_store.addressed(rows).groupBy("document", "length").agg(F.count("*").alias("copies"))


def audit_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Held sources that no call of the least protocol ever read."""
    log = table(spark, folder, "call_records").select("document", "protocol")
    held = table(spark, folder, "sources")
    first = log.agg(F.min("protocol")).first()[0] or ""
    return audit.uncovered(held, log, first).withColumn("protocol", F.lit(first))


def audit_all_protocols(spark: SparkSession, folder: str) -> DataFrame:
    """Held sources that no call of a protocol ever read, for every protocol."""
    return audit.uncovered_by_protocol(table(spark, folder, "sources"), table(spark, folder, "call_records"))


QUERIES = {
    q.__name__: q
    for q in (
        corroborated_claims, admission_report, admission_into_known, admission_publications, publications_into_known,
        repeated_citations, coverage_by_source, store_admissions, document_dedup, audit_coverage, audit_all_protocols,
    )
}

_LINKS_SQL = f"""
docs AS (SELECT doc_id AS run, {i.document_sql('encode(text)')} AS document, lang, source, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT run, document, lang, source, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(0, len(string_split(text, chr(10))))) AS ordinal FROM docs),
normal AS (SELECT run, document, ordinal, {normalized_sql("coalesce(lang, '')")} AS scope,
                  {normalized_sql("coalesce(source, '')")} AS concept_name, {normalized_sql('line')} AS claim_text FROM lines),
named AS (SELECT *, concept_name <> '' AND claim_text <> '' AS complete,
                 CASE WHEN concept_name <> '' AND claim_text <> '' THEN {i.concept_sql('concept_name')} END AS concept FROM normal),
claimed AS (SELECT *, {i.claim_sql('concept', 'claim_text')} AS claim FROM named),
links AS (SELECT *, {i.assertion_sql('claim', 'document', 'scope')} AS assertion FROM claimed)"""


def held_sql(table_name: str, key: str, removed: bool = True) -> str:
    """The last loaded open row of every key, as ``KnowledgeGraph.of_tables`` has it."""
    extra = "successor DESC NULLS LAST, because DESC NULLS LAST" if table_name == "concepts" else "1"
    where = f"{key} IS NOT NULL" + (" AND removed_at IS NULL" if removed else "")
    return f"""(SELECT * FROM {table_name} WHERE {where} QUALIFY row_number() OVER (
      PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST, at_seconds DESC NULLS LAST, standing DESC NULLS LAST, {extra}) = 1)"""


_CITED_SQL = f"""
known AS {held_sql('concepts', 'concept')},
known_claims AS {held_sql('claims', 'claim')},
made AS (SELECT coalesce(a.at_seconds // 86400, -1) AS run, coalesce(a.source, '') AS document,
                {normalized_sql("coalesce(a.scope, '')")} AS scope, c.concept, c.claim, k.standing, k.canonical_name
         FROM assertions a JOIN known_claims c USING (claim) JOIN known k ON k.concept = c.concept
         WHERE {normalized_sql("coalesce(k.canonical_name, '')")} <> '' AND {normalized_sql("coalesce(c.text, '')")} <> ''),
cited AS (SELECT *, {i.assertion_sql('claim', 'document', 'scope')} AS assertion FROM made)"""

ORACLE = {
    "corroborated_claims": f"WITH {_LINKS_SQL} SELECT claim, count(DISTINCT document) AS documents FROM links WHERE complete GROUP BY 1 HAVING count(DISTINCT document) >= 2",
    "admission_report": f"""WITH {_LINKS_SQL}
SELECT run, document, count(*) AS proposals, count(*) FILTER (NOT complete) AS refused,
       count(DISTINCT assertion) AS citations, count(assertion) - count(DISTINCT assertion) AS repeated,
       count(DISTINCT claim) AS claims, count(DISTINCT concept) AS concepts, count(concept) - count(DISTINCT concept) AS merged,
       0::BIGINT AS closed, CASE WHEN count(assertion) > 0 THEN 'yielded' ELSE 'barren' END AS coverage
FROM links GROUP BY run, document""",
    "admission_into_known": f"""WITH {_CITED_SQL}
SELECT run, document, count(DISTINCT concept) AS concepts, count(DISTINCT claim) AS claims, count(DISTINCT assertion) AS citations,
       count(*) - count(DISTINCT assertion) AS repeated, count(*) - count(DISTINCT concept) AS merged,
       count(DISTINCT concept) FILTER (standing IS DISTINCT FROM 'asserted') AS closed
FROM cited GROUP BY run, document""",
    "admission_publications": f"""WITH {_LINKS_SQL}
SELECT DISTINCT run, 0 AS rank, 'concept' AS kind, concept AS id, '' AS ref, concept_name AS text, '' AS source, '' AS scope FROM links WHERE complete
UNION ALL SELECT DISTINCT run, 1, 'claim', claim, concept, claim_text, '', '' FROM links WHERE complete
UNION ALL SELECT DISTINCT run, 2, 'assertion', assertion, claim, '', document, scope FROM links WHERE complete""",
    "publications_into_known": f"""WITH {_CITED_SQL}
SELECT run, kind, count(DISTINCT id) AS records, min(id) AS least FROM (
  SELECT run, 'concept' AS kind, concept AS id FROM cited WHERE standing = 'asserted'
  UNION ALL SELECT run, 'claim', claim FROM cited UNION ALL SELECT run, 'assertion', assertion FROM cited) GROUP BY ALL""",
    "repeated_citations": f"""WITH {_LINKS_SQL}
SELECT run, ordinal::INTEGER AS ordinal, assertion FROM links WHERE complete
QUALIFY row_number() OVER (PARTITION BY run, assertion ORDER BY ordinal) > 1""",
    "coverage_by_source": f"""WITH {_LINKS_SQL}, per AS (SELECT run, CASE WHEN count(assertion) > 0 THEN 'yielded' ELSE 'barren' END AS coverage FROM links GROUP BY run)
SELECT source, coalesce(coverage, 'unmet') AS coverage, count(*) AS runs FROM documents d LEFT JOIN per ON per.run = d.doc_id GROUP BY ALL""",
    "store_admissions": f"""WITH offered AS (SELECT DISTINCT {i.document_sql('content')} AS document, octet_length(content)::BIGINT AS length FROM sources WHERE content IS NOT NULL)
SELECT document, length, CASE WHEN length = 0 THEN 'vacuous' WHEN document IN (SELECT source FROM assertions WHERE source IS NOT NULL) THEN 'already present' ELSE 'stored' END AS admission FROM offered""",
    "document_dedup": f"""SELECT {i.document_sql('encode(text)')} AS document, strlen(text)::BIGINT AS length, count(*) AS copies
FROM documents WHERE text IS NOT NULL GROUP BY 1, 2""",
    "audit_coverage": """WITH p AS (SELECT min(protocol) AS protocol FROM call_records)
SELECT DISTINCT document, protocol FROM sources, p
WHERE document NOT IN (SELECT c.document FROM call_records c, p WHERE c.protocol = p.protocol AND c.document IS NOT NULL)""",
    "audit_all_protocols": """SELECT s.document, p.protocol FROM (SELECT DISTINCT document FROM sources) s,
  (SELECT DISTINCT protocol FROM call_records WHERE protocol IS NOT NULL) p
WHERE NOT EXISTS (SELECT 1 FROM call_records c WHERE c.document = s.document AND c.protocol = p.protocol)""",
}
