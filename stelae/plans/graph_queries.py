"""Queries of the log, the fold, the two worlds, tools, history and closing.

The *log* is the publications table without its deletes, in order of arrival; the
*graph* is that of the loaded tables concepts, claims and assertions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions import identity as i
from stelae.functions.normalize import normalized_sql
from stelae.operators import audit, closing, graph, history, tools
from stelae.operators.change_feed import operation
from stelae.operators.graph import KnowledgeGraph
from stelae.operators.retrieval import CurrentQueries, HistoricalQueries
from stelae.plans.admission_queries import held_sql
from stelae.sources.tables import table

_WORDS = "iron by"
_AS_OF = 1_718_000_000
_SHARE = 2  # history_through asks for the first half of the log


def log_view(spark: SparkSession, folder: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (
        table(spark, folder, "publications")
        .filter(operation(F.col("op")).isin("insert", "update"))
        .select(
            F.col("arrival").alias("seq"), "kind", "standing", text("successor"), text("because"), text("ref"), text("text"),
            F.lit("").alias("source"), F.lit("").alias("scope"), F.col("at_seconds").alias("at"),
        )
    )


def table_graph(spark: SparkSession, folder: str) -> KnowledgeGraph:
    return KnowledgeGraph.of_tables(*(table(spark, folder, n) for n in ("concepts", "claims", "assertions")))


def record_render(spark: SparkSession, folder: str) -> DataFrame:
    return graph.rendered(log_view(spark, folder))


def record_parse(spark: SparkSession, folder: str) -> DataFrame:
    return graph.parsed(graph.rendered(log_view(spark, folder)))


def replay_violations(spark: SparkSession, folder: str) -> DataFrame:
    return graph.violations(log_view(spark, folder))


def replay_first_error(spark: SparkSession, folder: str) -> DataFrame:
    return graph.first_violation(log_view(spark, folder)).select("seq", "kind", "error")


def held_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return KnowledgeGraph.folded(log_view(spark, folder)).concepts


def held_claims(spark: SparkSession, folder: str) -> DataFrame:
    return KnowledgeGraph.folded(log_view(spark, folder)).claims


def held_assertions(spark: SparkSession, folder: str) -> DataFrame:
    return table_graph(spark, folder).assertions.select("assertion", "claim", "source", "scope", "standing")


def current_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return table_graph(spark, folder).current().concepts()


def current_claims(spark: SparkSession, folder: str) -> DataFrame:
    return table_graph(spark, folder).current().claims()


def current_assertions(spark: SparkSession, folder: str) -> DataFrame:
    return table_graph(spark, folder).current().assertions()


def merge_losers(spark: SparkSession, folder: str) -> DataFrame:
    return tools.answer(table_graph(spark, folder), "merge_losers")


def search_current(spark: SparkSession, folder: str) -> DataFrame:
    return tools.answer(table_graph(spark, folder), "search", _WORDS)


def search_historical(spark: SparkSession, folder: str) -> DataFrame:
    return HistoricalQueries(table_graph(spark, folder)).claims_matching(_WORDS).select("claim", "text", "standing")


def search_empty(spark: SparkSession, folder: str) -> DataFrame:
    return CurrentQueries(table_graph(spark, folder)).claims_matching(" \t ")


def get_concept(spark: SparkSession, folder: str) -> DataFrame:
    return tools.answer(table_graph(spark, folder), "get_concept", "iron")


def _busiest(held: KnowledgeGraph, current: bool) -> str:
    """Name of the concept with most claims, the least identity on a tie."""
    claims = held.current().claims() if current else held.claims
    concepts = held.current().concepts() if current else held.concepts
    most = claims.groupBy("concept").agg(F.count("*").alias("n")).join(concepts.select("concept", "canonical_name"), "concept")
    top = most.orderBy(F.col("n").desc(), "concept").limit(1).collect()
    return top[0].canonical_name if top else ""


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    held = table_graph(spark, folder)
    return tools.answer(held, "neighbours", _busiest(held, True))


def held_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    held = table_graph(spark, folder)
    return tools.answer(held, "held_neighbours", _busiest(held, False))


def corpus_surface(spark: SparkSession, folder: str) -> DataFrame:
    return tools.surface(table_graph(spark, folder))


def history_counts(spark: SparkSession, folder: str) -> DataFrame:
    return history.counts(log_view(spark, folder))


def history_through(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the first half of the log's positions."""
    log = log_view(spark, folder)
    return history.counts(history.through(log, (log.agg(F.max("seq")).first()[0] or 0) // _SHARE))


def history_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return history.counts(history.as_of(log_view(spark, folder), _AS_OF))


def history_as_of_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return history.timeline(log_view(spark, folder))


def closing_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every concept row proposed as a closing: a merge into its successor's name, or
    a retirement."""
    held = table_graph(spark, folder)
    rows = table(spark, folder, "concepts").select("canonical_name", F.coalesce("successor", F.lit("")).alias("next"), "because")
    named = held.concepts.select(F.col("concept").alias("next"), F.col("canonical_name").alias("into"))
    proposals = rows.join(named, "next", "left").select(
        F.col("canonical_name").alias("name"), "into", F.col("because"), (F.col("next") != "").alias("merging")
    )
    judged = closing.verdicts(proposals.distinct(), held)
    kind = F.regexp_replace(F.coalesce("refusal", F.lit("accepted")), "named .* (to|is)", "named X $1")
    return judged.groupBy(kind.alias("verdict")).agg(F.count("*").alias("closings"))


def audit_merges(spark: SparkSession, folder: str) -> DataFrame:
    return audit.merges(log_view(spark, folder))


def audit_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    log = log_view(spark, folder)
    acts = log.filter("kind = 'concept' AND standing = 'superseded'").select(F.lit(1).alias("act"))
    wrong = audit.merges(log).select(F.lit(0).alias("act"))
    counted = acts.unionByName(wrong).agg(F.sum("act").alias("eligible"), F.count_if(F.col("act") == 0).alias("found"))
    eligible = F.coalesce("eligible", F.lit(0))
    return counted.select(
        F.lit("merges").alias("audit"), eligible.alias("eligible"), "found",
        audit.verdict(eligible, eligible, F.col("found")).alias("verdict"),
    )


def stale_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims as artifacts of their concepts, assertions as artifacts of their claims:
    what is unsupported, stale or reached by it once removals and mergers count."""
    concepts, claims = table(spark, folder, "concepts"), table(spark, folder, "claims")
    assertions = table(spark, folder, "assertions")
    derived = (
        claims.filter("concept IS NOT NULL").select(F.col("claim").alias("artifact"), F.col("concept").alias("input"), F.lit("asserted").alias("identity_then"))
        .unionByName(assertions.filter("claim IS NOT NULL").select(F.col("assertion").alias("artifact"), F.col("claim").alias("input"), F.lit("held").alias("identity_then")))
        .distinct()
    )
    held = KnowledgeGraph.of_tables(concepts, claims, assertions)
    now = held.concepts.select(F.col("concept").alias("input"), F.coalesce("standing", F.lit("")).alias("identity_now")).unionByName(
        held.claims.select(F.col("claim").alias("input"), F.lit("held").alias("identity_now"))
    )
    return audit.stale(derived, now).withColumn("path", F.array_join("path", " "))


QUERIES = {
    q.__name__: q
    for q in (
        record_render, record_parse, replay_violations, replay_first_error, held_concepts, held_claims, held_assertions,
        current_concepts, current_claims, current_assertions, merge_losers, search_current, search_historical, search_empty,
        get_concept, neighbours, held_neighbours, corpus_surface, history_counts, history_through, history_as_of,
        history_as_of_timeline, closing_verdicts, audit_merges, audit_verdicts, stale_claims,
    )
}

_HEX = "'[0-9a-f]{64}'"
_LOG = f"""
log AS (SELECT arrival AS seq, kind, standing, coalesce(successor, '') AS successor, coalesce(because, '') AS because,
               coalesce(ref, '') AS ref, coalesce(text, '') AS text, '' AS source, '' AS scope, at_seconds AS "at"
        FROM publications WHERE lower(op) NOT IN ('d', 'delete')),
identified AS (SELECT *, CASE kind WHEN 'concept' THEN {i.concept_sql('text')}
   WHEN 'claim' THEN {i.claim_sql(f"CASE WHEN regexp_full_match(ref, {_HEX}) THEN ref END", 'text')} END AS id FROM log)"""
_RECORD = """CASE kind WHEN 'concept' THEN concat_ws(chr(31), kind, coalesce(standing, ''), successor, because, text)
  ELSE concat_ws(chr(31), kind, coalesce(standing, ''), successor, because, ref, text) END
  || CASE WHEN "at" IS NULL THEN '' ELSE chr(31) || "at" END"""
_VIOLATIONS = f"""{_LOG},
firsts AS (SELECT id AS ref, min(seq) AS first FROM identified WHERE kind = 'concept' AND id IS NOT NULL GROUP BY 1),
judged AS (SELECT seq, kind, l.ref, standing, CASE
    WHEN kind NOT IN ('concept', 'claim') THEN 'malformed'
    WHEN kind = 'claim' AND NOT regexp_full_match(l.ref, {_HEX}) THEN 'unaddressed'
    WHEN kind = 'claim' AND NOT coalesce(first < seq, false) THEN 'out of order'
    WHEN NOT coalesce((standing = 'asserted' AND successor = '' AND because = '')
      OR (standing = 'retired' AND successor = '' AND because <> '')
      OR (standing = 'superseded' AND regexp_full_match(successor, {_HEX}) AND because <> ''), false) THEN 'malformed' END AS error
  FROM identified l LEFT JOIN firsts f ON kind = 'claim' AND f.ref = l.ref)"""


def _folded(of: str) -> str:
    return f"""{of},
held_c AS (SELECT id AS concept, {normalized_sql('text')} AS canonical_name, standing, successor, because FROM identified WHERE kind = 'concept' AND id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
held_k AS (SELECT id AS claim, ref AS concept, {normalized_sql('text')} AS text, standing, successor, because FROM identified WHERE kind = 'claim' AND id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


_COUNTS = """SELECT (SELECT count(*) FROM held_c WHERE standing = 'asserted') AS concepts,
  (SELECT count(*) FROM held_k WHERE standing = 'asserted' AND concept IN (SELECT concept FROM held_c WHERE standing = 'asserted')) AS claims,
  0::BIGINT AS citations, (SELECT count(*) FROM held_c) AS held"""

_GRAPH = f"""
gc AS (SELECT concept, {normalized_sql("coalesce(canonical_name, '')")} AS canonical_name, standing, coalesce(successor, '') AS successor, coalesce(because, '') AS because FROM {held_sql('concepts', 'concept')}),
gk AS (SELECT claim, concept, {normalized_sql("coalesce(text, '')")} AS text, standing FROM {held_sql('claims', 'claim')}),
ga AS (SELECT assertion, claim, {normalized_sql("coalesce(source, '')")} AS source, {normalized_sql("coalesce(scope, '')")} AS scope, standing FROM {held_sql('assertions', 'assertion', False)}),
cc AS (SELECT concept, canonical_name FROM gc WHERE standing = 'asserted'),
ck AS (SELECT claim, concept, text FROM gk WHERE standing = 'asserted' AND concept IN (SELECT concept FROM cc)),
ca AS (SELECT assertion, claim, source, scope FROM ga WHERE standing = 'asserted' AND claim IN (SELECT claim FROM ck))"""

_PHRASE = """CASE WHEN standing = 'asserted' THEN 'current' ELSE
  (CASE WHEN {s} <> '' THEN 'superseded by ' || {s} ELSE 'retired' END) || (CASE WHEN {b} <> '' THEN ': ' || {b} ELSE '' END) END"""

ORACLE = {
    "record_render": f"WITH {_LOG} SELECT seq, {_RECORD} AS record FROM log",
    "record_parse": f"""WITH {_LOG} SELECT seq, kind, coalesce(standing, '') AS standing, successor, because,
  CASE WHEN kind = 'concept' THEN '' ELSE ref END AS ref, text, source, scope, "at", true AS shaped FROM log""",
    "replay_violations": f"""WITH {_VIOLATIONS} SELECT seq, kind, error, CASE error WHEN 'out of order' THEN ref
  WHEN 'unaddressed' THEN CASE WHEN length(ref) <> 64 THEN 'wrong length ' || length(ref) ELSE 'not a digit ' || regexp_extract(ref, '([^0-9a-f])', 1) END
  ELSE standing END AS detail FROM judged WHERE error IS NOT NULL""",
    "replay_first_error": f"WITH {_VIOLATIONS} SELECT seq, kind, error FROM judged WHERE error IS NOT NULL ORDER BY seq LIMIT 1",
    "held_concepts": f"WITH {_folded(_LOG)} SELECT * FROM held_c",
    "held_claims": f"WITH {_folded(_LOG)} SELECT * FROM held_k",
    "held_assertions": f"WITH {_GRAPH} SELECT assertion, claim, source, scope, standing FROM ga",
    "current_concepts": f"WITH {_GRAPH} SELECT * FROM cc",
    "current_claims": f"WITH {_GRAPH} SELECT * FROM ck",
    "current_assertions": f"WITH {_GRAPH} SELECT * FROM ca",
    "merge_losers": f"""WITH {_GRAPH} SELECT 0 AS section, concept AS id, canonical_name || ' -> ' ||
  (CASE WHEN successor = '' THEN '?' ELSE successor END) || ' (' || (CASE WHEN because = '' THEN 'no reason recorded' ELSE because END) || ')' AS line
FROM gc WHERE standing = 'superseded'""",
    "search_current": f"WITH {_GRAPH} SELECT 0 AS section, claim AS id, text AS line FROM ck WHERE contains(text, 'iron') AND contains(text, 'by')",
    "search_historical": f"WITH {_GRAPH} SELECT claim, text, standing FROM gk WHERE contains(text, 'iron') AND contains(text, 'by')",
    "search_empty": f"WITH {_GRAPH} SELECT * FROM ck WHERE false",
    "get_concept": f"WITH {_GRAPH} SELECT 0 AS section, concept AS id, canonical_name AS line FROM cc WHERE contains(canonical_name, 'iron')",
    "neighbours": f"""WITH {_GRAPH},
top AS (SELECT concept, canonical_name FROM ck JOIN cc USING (concept) GROUP BY ALL ORDER BY count(*) DESC, concept LIMIT 1),
n AS (SELECT concept, canonical_name FROM cc WHERE canonical_name = (SELECT canonical_name FROM top)),
k AS (SELECT * FROM ck WHERE concept IN (SELECT concept FROM n))
SELECT 0 AS section, concept AS id, 'concept  ' || canonical_name AS line FROM n
UNION ALL SELECT 1, claim, 'claim    ' || text FROM k
UNION ALL SELECT 2, assertion, 'cited    ' || source || ' [' || (CASE WHEN scope = '' THEN 'scope unstated' ELSE scope END) || ']' FROM ca WHERE claim IN (SELECT claim FROM k)""",
    "held_neighbours": f"""WITH {_GRAPH},
n AS (SELECT gc.* FROM gc JOIN (SELECT concept, count(*) AS n FROM gk GROUP BY 1) USING (concept) ORDER BY n DESC, concept LIMIT 1),
k AS (SELECT * FROM gk WHERE concept IN (SELECT concept FROM n))
SELECT 0 AS section, concept AS id, 'concept  ' || canonical_name || ' [' || {_PHRASE.format(s='successor', b='because')} || ']' AS line FROM n
UNION ALL SELECT 1, claim, 'claim    ' || text || ' [' || (CASE WHEN claim IN (SELECT claim FROM ck) THEN 'current' WHEN standing = 'asserted' THEN 'not current: its concept is not' ELSE 'retired' END) || ']' FROM k
UNION ALL SELECT 2, assertion, 'cited    ' || source || ' [' || (CASE WHEN assertion IN (SELECT assertion FROM ca) THEN 'current' WHEN standing = 'asserted' THEN 'not current: what it cites is not' ELSE 'retired' END) || ']'
FROM ga WHERE claim IN (SELECT claim FROM k)""",
    "corpus_surface": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM cc) AS current, (SELECT count(*) FROM gc) AS held",
    "history_counts": f"WITH {_folded(_LOG)} {_COUNTS}",
    "history_through": f"WITH {_folded(_LOG + f', prefix AS (SELECT * FROM identified WHERE seq <= (SELECT coalesce(max(seq), 0) // {_SHARE} FROM log))').replace('FROM identified WHERE kind', 'FROM prefix WHERE kind')} {_COUNTS}",
    "history_as_of": f"""WITH {_folded(_LOG + f''', prefix AS (SELECT * FROM identified
  WHERE seq < coalesce((SELECT min(seq) FROM log WHERE "at" > {_AS_OF}), 9223372036854775807))''').replace('FROM identified WHERE kind', 'FROM prefix WHERE kind')} {_COUNTS}""",
    "history_as_of_timeline": f"""WITH {_LOG}, aged AS (SELECT kind, max("at") OVER (ORDER BY seq) AS age FROM log)
SELECT CASE WHEN age IS NULL THEN 'untimed' ELSE strftime(make_timestamp(age * 1000000), '%Y-%m') END AS month,
       count(*) AS publications, count(*) FILTER (kind = 'concept') AS concept_records FROM aged GROUP BY 1""",
    "closing_verdicts": f"""WITH {_GRAPH},
proposed AS (SELECT DISTINCT c.canonical_name AS name, n.canonical_name AS into_name, c.because, coalesce(c.successor, '') <> '' AS merging
             FROM concepts c LEFT JOIN gc n ON n.concept = coalesce(c.successor, '')),
judged AS (SELECT CASE
    WHEN {normalized_sql("coalesce(p.because, '')")} = '' THEN 'a reason is required'
    WHEN o.concept IS NULL THEN 'nothing published a concept named X to close'
    WHEN o.standing IS DISTINCT FROM 'asserted' THEN 'a concept named X is already ' || (CASE WHEN o.successor <> '' THEN 'superseded' ELSE 'retired' END)
    WHEN merging AND into_name IS NULL THEN 'a successor is required'
    WHEN merging AND {i.concept_sql('into_name')} = {i.concept_sql('name')} THEN 'a concept cannot supersede itself'
    WHEN merging AND s.concept IS NULL THEN 'nothing published a concept named X to merge into'
    WHEN merging AND s.standing IS DISTINCT FROM 'asserted' THEN 'a concept named X is already ' || (CASE WHEN s.successor <> '' THEN 'superseded' ELSE 'retired' END)
    ELSE 'accepted' END AS verdict
  FROM proposed p LEFT JOIN gc o ON o.concept = {i.concept_sql('name')}
  LEFT JOIN gc s ON merging AND s.concept = {i.concept_sql('into_name')})
SELECT verdict, count(*) AS closings FROM judged GROUP BY 1""",
    "audit_merges": f"""WITH {_LOG}, c AS (SELECT *, lag(standing) OVER (PARTITION BY id ORDER BY seq) AS before FROM identified WHERE kind = 'concept'),
acts AS (SELECT c.*, (SELECT arg_max(p.standing, p.seq) FROM c p WHERE p.id = c.successor AND p.seq < c.seq) AS into_s FROM c WHERE standing = 'superseded'),
found AS (SELECT seq, id AS subject, CASE WHEN because = '' THEN 'no reason' WHEN before IS NULL THEN 'was not held'
  WHEN before <> 'asserted' THEN 'was closed already' WHEN successor = id THEN 'supersedes itself'
  WHEN into_s IS NULL THEN 'successor was not held' WHEN into_s <> 'asserted' THEN 'successor was closed' END AS finding FROM acts)
SELECT * FROM found WHERE finding IS NOT NULL""",
    "audit_verdicts": f"""WITH {_LOG} SELECT 'merges' AS audit, count(*) AS eligible, f.found,
  CASE WHEN count(*) = 0 THEN 'vacuous' WHEN f.found > 0 THEN 'failed' ELSE 'clean' END AS verdict
FROM log, (SELECT count(*) AS found FROM (AUDIT)) f WHERE kind = 'concept' AND standing = 'superseded' GROUP BY f.found""",
    "stale_claims": f"""WITH {_GRAPH},
derived AS (SELECT DISTINCT claim AS artifact, concept AS input, 'asserted' AS was FROM claims WHERE concept IS NOT NULL
            UNION SELECT DISTINCT assertion, claim, 'held' FROM assertions WHERE claim IS NOT NULL),
now AS (SELECT concept AS input, coalesce(standing, '') AS is_now FROM gc UNION ALL SELECT claim, 'held' FROM gk),
direct AS (SELECT artifact, CASE WHEN bool_or(is_now IS NULL) THEN 'unsupported' WHEN bool_or(is_now <> was) THEN 'stale' ELSE 'sound' END AS status,
           coalesce(min(input) FILTER (is_now IS NULL), min(input) FILTER (is_now <> was)) AS cause
           FROM derived LEFT JOIN now USING (input) GROUP BY 1),
hit AS (SELECT d.artifact, min(u.artifact || ' ' || u.cause) AS via FROM derived d JOIN direct u ON d.input = u.artifact WHERE u.status <> 'sound' GROUP BY 1)
SELECT artifact, CASE WHEN status = 'sound' AND via IS NOT NULL THEN 'propagated' ELSE status END AS status,
  CASE WHEN status <> 'sound' THEN artifact || ' ' || cause WHEN via IS NOT NULL THEN artifact || ' ' || via ELSE '' END AS path
FROM direct LEFT JOIN hit USING (artifact)""",
}
ORACLE["audit_verdicts"] = ORACLE["audit_verdicts"].replace("AUDIT", ORACLE["audit_merges"])
