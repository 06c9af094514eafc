"""Queries of readers, stores, logs, sessions and the acts of a workspace."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.functions import identity as i
from stelae.functions.normalize import normalized, normalized_sql
from stelae.functions.values import findings_of, has_run, is_evidence_of_absence
from stelae.operators import admission, audit, closing, graph, history, reading, relations, tools
from stelae.operators.graph import KnowledgeGraph
from stelae.operators.retrieval import CurrentQueries, HistoricalQueries
from stelae.operators.workspace import Workspace
from stelae.plans.admission_queries import _CITED_SQL, _citations
from stelae.plans.graph_queries import _GRAPH, _WORDS, log_view, table_graph
from stelae.plans.tables_queries import _WALKS_SQL
from stelae.session import Scratch, hadoop_path
from stelae.sources import content_store, record_log
from stelae.sources.tables import table

_MODEL, _INSTRUCTIONS, _SCOPE = "a model", "name every proposition", "subtitles"
_LOCATION = "pages 1 to 1 of the text"


# Readers and what comes of them.


def line_reader(document: str, content: bytes, needed: str) -> list[reading.Reading]:
    """Reads ``concept: claim`` lines.  It cannot read what is no text, says nothing of an empty
    one, fails on addresses that end in 9, answers for another document where one ends in 7, and
    finds nothing where one ends in 5."""
    if needed != reading.TEXT:
        raise reading.CannotRead("only text is read")
    try:
        text = content.decode()
    except UnicodeDecodeError as error:
        raise reading.CannotRead("no text") from error
    if not text:
        return []
    if document.endswith("9"):
        raise RuntimeError("no answer")
    named = "0" * 64 if document.endswith("7") else document
    said = [] if document.endswith("5") else [tuple(line.split(":", 1)) for line in text.split("\n") if ":" in line]
    return [reading.Reading(named, _LOCATION, said)]


def _handed(spark: SparkSession, folder: str) -> DataFrame:
    return content_store.addressed(table(spark, folder, "sources")).dropDuplicates(["document"])


def reading_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct source handed to a reader: what it found, or why nothing was read."""
    handed = _handed(spark, folder)
    answers = Scratch(spark, "answers").keep(reading.read_with(line_reader, handed, "lines", "line reader"), "answers")
    given, refused = reading.answered(answers)
    runs = reading.examined(handed, given, refused).withColumn("run", F.lit(0).cast("long"))
    said = reading.statements(reading.accepted(given, runs), runs)
    return admission.report(said, runs).select(
        "document", "readings", "refusal", "needs", "proposals", "refused", "concepts", "claims", "citations", "coverage"
    )


def unread_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Sources admitted without a reader."""
    runs = reading.examined(_handed(spark, folder)).withColumn("run", F.lit(0).cast("long"))
    none = spark.createDataFrame([], admission.STATEMENTS)
    return admission.report(none, runs).select("document", "refusal", "needs", "coverage")


def misdirected_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of which the reader read another document."""
    given, _ = reading.answered(reading.read_with(line_reader, _handed(spark, folder), "lines", "line reader"))
    return reading.misdirected(given)


def _replayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readings and refusals of all sources from recordings, which lack some answers and hold
    some malformed and some empty ones, by the last digit of the document."""
    parts = Scratch(spark, "passages").keep(reading.passages(_handed(spark, folder)), "parts")
    digit = F.substring("document", 64, 1)
    one = F.struct(F.lit("document").alias("concept"), F.concat(F.char_length("text").cast("string"), F.lit("  characters")).alias("claim"))
    answer = F.when(digit == "1", F.lit("{")).when(digit == "2", F.lit("[]")).otherwise(F.to_json(F.array(one)))
    asked = reading.requests(parts, _MODEL, _INSTRUCTIONS).join(parts.select("document", "passage", "text"), ["document", "passage"])
    recordings = asked.filter(digit != "0").select("fingerprint", answer.alias("answer"))
    return reading.recorded_readings(parts, recordings, _MODEL, _INSTRUCTIONS, " claims\u0085v1 ")


def replayed_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings and refusals by recorded answers, joined by the fingerprint of the request."""
    given, refused = _replayed(spark, folder)
    none = F.lit(None).cast("string")
    read = given.select(
        "document", none.alias("refusal"), none.alias("needs"), "location", "protocol", "reader", F.size("proposed").alias("proposals"),
        F.get("proposed", F.lit(0))["claim_text"].alias("claim"),
    )
    return read.unionByName(refused.select("document", "refusal", "needs"), allowMissingColumns=True)


def assertion_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading of an assertion as a fact of its own."""
    return reading.lineage(_replayed(spark, folder)[0])


def request_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """What every readable source is asked, and the version of the protocol."""
    asked = reading.requests(reading.passages(_handed(spark, folder)), _MODEL, _INSTRUCTIONS)
    return asked.select(
        "document", "passage", "fingerprint", "request.role", "request.output_tokens", F.octet_length("request.content").alias("octets"),
        reading.protocol_identity(_INSTRUCTIONS).alias("protocol"),
    )


def failed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that no answered call came to: unmet, not barren."""
    answered = table(spark, folder, "call_records").filter("outcome = 'answered'").select("document")
    return audit.failed_run(table(spark, folder, "sources"), answered)


def coverage_records(spark: SparkSession, folder: str) -> DataFrame:
    """The latest call of every document and protocol stands for its coverage."""
    log = table(spark, folder, "call_records").select(F.col("call_id").alias("seq"), "document", "protocol", "outcome").distinct()
    return audit.latest_coverage(log)


def coverage_values(spark: SparkSession, folder: str) -> DataFrame:
    """What each coverage of the sources says of having looked and of absence."""
    covered = reading_coverage(spark, folder).groupBy("coverage").agg(F.sum("citations").alias("n"), F.count("*").alias("documents"))
    name = F.col("coverage")
    return covered.select(
        "coverage", "documents", has_run(name).alias("has_run"), is_evidence_of_absence(name).alias("absence"), findings_of(name, F.col("n")).alias("findings")
    )


# Stores and logs.


def store_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All sources written twice into a durable store and read back."""
    store = content_store.DocumentStore(spark, Scratch(spark, "store").path("root"))
    contents = table(spark, folder, "sources")
    first, second = store.write(contents), store.write(contents)
    held = store.documents().select("document", F.sha2("content", 256).alias("digest"))
    there = store.holds(first.select("document")).withColumn("held", F.lit(True))
    return (
        first.join(second.select("document", F.col("admission").alias("again")), "document")
        .join(there, "document", "left")
        .join(held, "document", "left")
        .select("document", "length", "admission", "again", F.coalesce("held", F.lit(False)).alias("held"), "digest")
    )


def log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The log in normal form written as text, read again by lines, appended to a log table and
    read from it."""
    scratch = Scratch(spark, "log")
    log = log_view(spark, folder).withColumns({c: normalized(F.col(c)) for c in ("successor", "because", "ref", "text")})
    record_log.export_text(log, scratch.path("text"))
    kept = record_log.PublicationLog(spark, scratch.path("root"), create=True)
    kept.append(record_log.import_text(spark, scratch.path("text")))
    return kept.records()


def torn_log(spark: SparkSession, folder: str) -> DataFrame:
    """A text log whose last record was not written whole is refused, and so is one that is not there."""
    where, files = hadoop_path(spark, Scratch(spark, "torn").path("log.txt"))
    stream = files.create(where, True)
    stream.write(bytearray(b"concept\x1fasserted\x1f\x1f\x1fwhole\nconcept\x1fasserted\x1f\x1f\x1fto"))
    stream.close()
    told = []
    for name, path in (("torn", where.toString()), ("missing", Scratch(spark, "torn").path("none.txt"))):
        try:
            record_log.import_text(spark, path)
        except record_log.LogRefused:
            told.append((name, True))
        else:
            told.append((name, False))
    return spark.createDataFrame(told, "log string, refused boolean")


def source_file(spark: SparkSession, folder: str) -> DataFrame:
    """A file read whole as octets: the names of the regions, a line each."""
    path = Scratch(spark, "file").path("regions")
    table(spark, folder, "region").select("r_name").repartition(1).sortWithinPartitions("r_name").write.text(path)  # five rows
    read = content_store.source_files(spark, f"{path}/part-*.txt")
    return read.select(i.document_identity(F.col("content")).alias("document"), F.octet_length("content").alias("octets"))


def log_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A whole log that admissions made, checked and folded in one plan."""
    made = admission.numbered(admission.publications(_citations(spark, folder)), 0, 7)
    return history.replay(Scratch(spark, "made").keep(made, "log"))


def log_refused(spark: SparkSession, folder: str) -> DataFrame:
    """A log with bad records gives its first one and no counts."""
    return history.replay(log_view(spark, folder))


def published_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of a log with what admissions publish into it; the log before is untouched."""
    made = admission.numbered(admission.publications(_citations(spark, folder)), 0, 7)
    into = KnowledgeGraph.folded(graph.empty_log(spark).unionByName(made))
    return into.every_version().concepts().select("concept", "canonical_name", "standing")


# A workspace.


def workspace_admission(spark: SparkSession, folder: str) -> DataFrame:
    """All documents admitted into a durable workspace, every line said of its source."""
    rows = table(spark, folder, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    work = Workspace(spark, Scratch(spark, "workspace").path("root"))
    said = rows.select(
        F.col("doc_id").alias("run"), F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "claim_text"), F.col("source").alias("concept_name")
    )
    return work.admit(rows.select(F.col("doc_id").alias("run"), F.encode("text", "UTF-8").alias("content")), said, scope=_SCOPE, at=7).drop("refusal", "needs")


def workspace_reader(spark: SparkSession, folder: str) -> DataFrame:
    """All sources admitted through a reader; the coverage log keeps what came of each."""
    work = Workspace(spark)
    sources = _handed(spark, folder).select(F.lit(1).cast("long").alias("run"), "content")
    work.admit(sources, reader=line_reader, protocol="lines", name="line reader", at=7)
    return work.coverage.records().select("document", "protocol", "reader", "outcome", "amount", "needs", "at")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """One asserted record per name of a held concept."""
    names = table_graph(spark, folder).concepts.filter("canonical_name <> ''").select(F.col("canonical_name").alias("text")).distinct()
    empty = F.lit("")
    return record_log.with_positions(names, ["text"], "seq").select(
        "seq", F.lit("concept").alias("kind"), F.lit(graph.ASSERTED).alias("standing"), empty.alias("successor"), empty.alias("because"),
        empty.alias("ref"), "text", empty.alias("source"), empty.alias("scope"), F.lit(1).cast("long").alias("at"),
    )


def closings_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts retired and superseded by the last digit of their identity, half of the retired
    ones reopened: what is held at each standing, and since when."""
    log = Scratch(spark, "named").keep(_named(spark, folder), "log")
    held = KnowledgeGraph.folded(log)
    digit = F.substring("concept", 64, 1)
    least = held.concepts.agg(F.min_by("canonical_name", "concept")).scalar()
    asked = held.concepts.filter(digit.isin("0", "1")).select(
        F.col("canonical_name").alias("name"), F.when(digit == "1", least).alias("into"), F.lit("no longer\nused").alias("because"), (digit == "1").alias("merging")
    )
    count = log.count()
    closed = Scratch(spark, "closed").keep(closing.publications(closing.verdicts(asked, held), count + 1, 2), "log")
    after = log.unionByName(closed)
    again = KnowledgeGraph.folded(after)
    retired = again.concepts.filter((F.col("standing") == graph.RETIRED) & F.substring("concept", 63, 1).between("0", "7"))
    judged = closing.reopenings(retired.select(F.col("canonical_name").alias("name"), F.lit("used again").alias("because")), again)
    whole = after.unionByName(closing.reopened(judged, count + closed.count() + 1, 3))
    last = graph.latest(whole, "concept")
    return last.groupBy("standing", "because", "at").agg(F.count("*").alias("concepts"), F.count(F.when(graph.is_current(F.col("standing")), 1)).alias("current"))


# Questions.


def _top(held: KnowledgeGraph, current: bool) -> str:
    claims = held.current().claims() if current else held.claims
    concepts = held.current().concepts() if current else held.concepts
    most = claims.groupBy("concept").agg(F.count("*").alias("n")).join(concepts.select("concept"), "concept")
    top = most.orderBy(F.col("n").desc(), "concept").head(1)
    return top[0].concept if top else ""


def current_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """The current concept with most claims, its claims and their citations."""
    held = table_graph(spark, folder)
    concept, claims, cited = CurrentQueries(held).neighbourhood_of(_top(held, True))
    part = lambda rows, kind, key, text: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"))
    return part(concept, "concept", "concept", "canonical_name").unionByName(part(claims, "claim", "claim", "text")).unionByName(
        part(cited, "assertion", "assertion", "source")
    )


def historical_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """The held concept with most claims and all ever attached to it, each current or not."""
    held = table_graph(spark, folder)
    concept, claims, cited = HistoricalQueries(held).neighbourhood_of(_top(held, False))
    live = graph.is_current(F.col("standing"))
    part = lambda rows, kind, key, flag: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "standing", flag.alias("current"))
    return part(concept, "concept", "concept", live).unionByName(part(claims, "claim", "claim", F.col("current"))).unionByName(
        part(cited, "assertion", "assertion", F.col("current"))
    )


def concept_counts(spark: SparkSession, folder: str) -> DataFrame:
    held = table_graph(spark, folder)
    now = CurrentQueries(held).concept_count().select(F.lit("current").alias("world"), "concepts")
    return now.unionByName(HistoricalQueries(held).concept_count().select(F.lit("historical").alias("world"), "concepts"))


def answer_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as a person reads them."""
    held = table_graph(spark, folder)
    asked = [("search", _WORDS), ("search", " "), ("merge_losers", "")]
    told = [(tool, argument, tools.rendered(tools.answer(held, tool, argument))) for tool, argument in asked]
    return spark.createDataFrame(told, "tool string, argument string, answer string")


_SESSION = (
    {"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/call", "params": {"name": "search", "arguments": {"argument": _WORDS}}},
    {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"argument": 5}}},
    {"id": 4, "method": "tools/call", "params": {"name": "unheard_of"}}, {"method": "notifications/initialized"},
    {"id": 5, "method": "tools/call", "params": {}}, {"id": 6, "method": "elsewhere"}, {"id": 7, "method": "tools/call", "params": {"name": "search"}},
)


def tool_session(spark: SparkSession, folder: str) -> DataFrame:
    """A session of good and bad calls; none ends it."""
    lines = [json.dumps({"jsonrpc": "2.0", **r}) for r in _SESSION] + ["no json", ""]
    replies = [json.loads(r) for r in tools.session(table_graph(spark, folder), lines)]
    rows = []
    for r in replies:
        result = r.get("result", {})
        text = result["content"][0]["text"] if "content" in result else None
        rows.append((r["id"], r.get("error", {}).get("code"), result.get("isError"), text))
    return spark.createDataFrame(rows, "id int, code int, failed boolean, text string")


def tool_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The tools a session lists, and how many concepts the listing says there are."""
    listed = tools.listing(table_graph(spark, folder)).splitlines()
    corpus = next(line for line in listed if line.startswith("corpus"))
    rows = [(t["name"], t["description"].split("]")[0].strip("["), "argument" in t["inputSchema"]["properties"], any(t["name"] in line for line in listed), corpus) for t in tools.catalogue()]
    return spark.createDataFrame(rows, "name string, world string, takes_argument boolean, listed boolean, corpus string")


# Derivations, promotion, relations.


def derivation_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A derivation with an absent field and fields left out, and what it lists of them."""
    made = (
        i.Derivation("reading").octets("content", F.col("content")).absent("scope").text("origin", F.coalesce("origin", F.lit("")))
        .excluding("arrival", "when it came says nothing of what it is").excluding("length", "the octets decide")
    )
    rows = table(spark, folder, "sources").filter("content IS NOT NULL")
    left_out = ", ".join(f"{name}: {because}" for name, because in made.excluded)
    return rows.select(made.seal().alias("identity"), F.lit(" ".join(made.included)).alias("included"), F.lit(left_out).alias("excluded")).distinct()


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Scopes in normal form; a scope that names nothing is unstated."""
    named = normalized(F.coalesce("scope", F.lit("")))
    return table(spark, folder, "assertions").groupBy(F.nullif(named, F.lit("")).alias("scope")).agg(F.count("*").alias("assertions"))


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """A broader claim for every current concept, resting on the citations of its claims."""
    world = table_graph(spark, folder).current()
    broader = world.concepts().select(F.col("concept").alias("promotion"), "concept", F.lit("holds in general").alias("text"))
    narrow = world.assertions().join(world.claims().select("claim", F.col("concept").alias("promotion")), "claim").select("promotion", "assertion")
    return admission.promoted(broader, narrow)


def derivation_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Successor links taken as derivations: those the write path refuses."""
    links = table(spark, folder, "concepts").filter("removed_at IS NULL AND standing = 'superseded' AND concept <> '' AND successor <> ''")
    proposed = links.groupBy(F.col("concept").alias("artifact")).agg(F.min("successor").alias("input")).withColumn("identity_then", F.lit("1"))
    _, refused = audit.derive(proposed.limit(0), proposed)
    return refused


_DECLARED = (
    ("same as", "identity", ("reflexive", "symmetric", "transitive")), ("resembles", "identity", ("reflexive", "symmetric")),
    ("part of", "compositional", ("transitive",)), ("friend of", "friendship", ()), ("like", "analogy", ("symmetric", "transitive")),
)
_DEMANDS = (*relations.IDENTITY_DEMANDS, ("analogy", "transitive", False), ("compositional", "transitive", True))


def relation_algebra(spark: SparkSession, folder: str) -> DataFrame:
    """Declared relations with what they break of their kinds' demands, or that they may be closed over."""
    rows = [(name, kind, *(p in given for p in relations.PROPERTIES)) for name, kind, given in _DECLARED]
    declared, demands = spark.createDataFrame(rows, relations.RELATIONS), spark.createDataFrame(list(_DEMANDS), relations.DEMANDS)
    fine = relations.certified(declared, demands).select("relation", F.lit("transitive").alias("property"), F.lit("certified").alias("fault"))
    return relations.algebra_faults(declared, demands).unionByName(fine)


def delete_permits(spark: SparkSession, folder: str) -> DataFrame:
    """May what the calls of a protocol and model derived be deleted?  Only where every call was
    answered (complete inputs) by the one model (deterministic), of extractors (derived rows)."""
    calls = table(spark, folder, "call_records").groupBy("protocol", "model").agg(
        (F.count("model") == F.count("*")).alias("deterministic"), F.coalesce(F.min(F.col("outcome") == "answered"), F.lit(False)).alias("inputs_complete"),
        F.coalesce(F.min(F.col("role") == reading.ROLE), F.lit(False)).alias("scoped_to_derived"),
    )
    return audit.permitted_deletes(calls).select("protocol", "model", "refusal")


QUERIES = {
    q.__name__: q
    for q in (
        reading_coverage, unread_coverage, misdirected_readings, replayed_readings, assertion_readings, request_fingerprints, failed_runs,
        coverage_records, coverage_values, store_round_trip, log_round_trip, torn_log, source_file, log_replay, log_refused, published_graph, workspace_admission,
        workspace_reader, closings_recorded, current_neighbourhood, historical_neighbourhood, concept_counts, answer_lines, tool_session,
        tool_catalogue, derivation_parts, scopes, promotions, derivation_cycles, relation_algebra, delete_permits,
    )
}

_N = normalized_sql
_DOCS = f"docs AS (SELECT DISTINCT {i.document_sql('content')} AS document, content FROM sources WHERE content IS NOT NULL)"
_PARTS = f"{_DOCS}, parts AS (SELECT document, TRY(decode(content)) AS text FROM docs), readable AS (SELECT * FROM parts WHERE length(trim(text, ' ')) >= 1)"
_READ = f"""{_DOCS}, judged AS (SELECT document, text, CASE WHEN text IS NULL THEN 'cannot read' WHEN text <> '' AND right(document, 1) IN ('7', '9') THEN 'reader failed' END AS refusal
  FROM (SELECT document, TRY(decode(content)) AS text FROM docs)),
told AS (SELECT *, CASE WHEN refusal IS NULL AND text <> '' THEN 1 ELSE 0 END::BIGINT AS readings FROM judged),
lines AS (SELECT document, unnest(string_split(text, chr(10))) AS line FROM told WHERE readings = 1 AND right(document, 1) <> '5'),
said AS (SELECT document, {_N("substr(line, 1, instr(line, ':') - 1)")} AS c, {_N("substr(line, instr(line, ':') + 1)")} AS t FROM lines WHERE contains(line, ':')),
counted AS (SELECT document, count(*) AS proposals, count(*) FILTER (c = '' OR t = '') AS refused, count(DISTINCT c) FILTER (c <> '' AND t <> '') AS concepts,
  count(DISTINCT c || chr(31) || t) FILTER (c <> '' AND t <> '') AS claims FROM said GROUP BY 1),
covered AS (SELECT document, readings, refusal,
  CASE refusal WHEN 'cannot read' THEN 'a reading this extractor cannot do' WHEN 'reader failed' THEN 'an answer from the reader'
    ELSE CASE WHEN readings = 0 THEN 'the reader returned no reading' END END AS needs,
  coalesce(proposals, 0) AS proposals, coalesce(refused, 0) AS refused, coalesce(concepts, 0) AS concepts, coalesce(claims, 0) AS claims, coalesce(claims, 0) AS citations,
  CASE WHEN readings = 0 THEN 'unmet' WHEN coalesce(claims, 0) > 0 THEN 'yielded' ELSE 'barren' END AS coverage
FROM told LEFT JOIN counted USING (document))"""
_REQUEST = i._sealed_sql(
    "request", "'model'::BLOB", f"encode('{_MODEL}')", "'role'::BLOB", "encode('extractor')", "'instructions'::BLOB", f"encode('{_INSTRUCTIONS}')",
    "'most'::BLOB", "encode('32')", "'tokens'::BLOB", "encode('2048')", "'passage'::BLOB", "'<opaque>'::BLOB", "unhex(sha256(encode(text)))",
)
_PROTOCOL = i._sealed_sql(
    "protocol", "'instructions'::BLOB", f"encode('{_INSTRUCTIONS}')", "'schema'::BLOB", f"encode('{json.dumps(reading.ANSWER_SCHEMA)}')", "'most'::BLOB",
    "encode('32')", "'tokens'::BLOB", "encode('2048')", "'passage'::BLOB", "encode('4000')",
)
_SAID_OF_TEXT = "length(text) || ' characters'"
_LINES = f"""
docs AS (SELECT doc_id AS run, {i.document_sql('encode(text)')} AS document, source, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
lines AS (SELECT run, document, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
normal AS (SELECT run, document, text, {_N("coalesce(source, '')")} AS c, {_N('line')} AS t FROM lines),
named AS (SELECT *, CASE WHEN c <> '' AND t <> '' THEN {i.concept_sql('c')} END AS concept FROM normal),
claimed AS (SELECT *, {i.claim_sql('concept', 't')} AS claim FROM named)"""
_NAMED = f"""{_GRAPH}, named AS (SELECT DISTINCT canonical_name AS name FROM gc WHERE canonical_name <> ''),
base AS (SELECT {i.concept_sql('name')} AS id, name FROM named),
acts AS (SELECT id, CASE WHEN right(id, 1) = '0' THEN CASE WHEN substr(id, 63, 1) BETWEEN '0' AND '7' THEN 'reopened' ELSE 'retired' END
  WHEN right(id, 1) = '1' AND id <> (SELECT min(id) FROM base) THEN 'superseded' ELSE 'asserted' END AS standing FROM base)"""
_LOSERS = """(SELECT coalesce(string_agg(canonical_name || ' -> ' || (CASE WHEN successor = '' THEN '?' ELSE successor END) || ' (' ||
  (CASE WHEN because = '' THEN 'no reason recorded' ELSE because END) || ')', chr(10) ORDER BY concept), '(nothing)') FROM gc WHERE standing = 'superseded')"""
_FOUND = "(SELECT coalesce(string_agg(text, chr(10) ORDER BY claim), '(nothing)') FROM ck WHERE contains(text, 'iron') AND contains(text, 'by'))"

ORACLE = {
    "reading_coverage": f"WITH {_READ} SELECT * FROM covered",
    "unread_coverage": f"WITH {_DOCS} SELECT document, 'not read' AS refusal, 'a reader' AS needs, 'unmet' AS coverage FROM docs",
    "misdirected_readings": f"WITH {_READ} SELECT document AS asked FROM judged WHERE text <> '' AND right(document, 1) = '7'",
    "replayed_readings": f"""WITH {_PARTS}, r AS (SELECT p.document, q.text, CASE WHEN q.document IS NULL THEN 'cannot read' WHEN right(p.document, 1) IN ('0', '1') THEN 'reader failed' END AS refusal
  FROM parts p LEFT JOIN readable q USING (document))
SELECT document, refusal, CASE refusal WHEN 'cannot read' THEN 'a reading this extractor cannot do' WHEN 'reader failed' THEN 'an answer from the reader' END AS needs,
  CASE WHEN refusal IS NULL THEN '{_LOCATION}' END AS location, CASE WHEN refusal IS NULL THEN 'claims v1' END AS protocol, CASE WHEN refusal IS NULL THEN '{_MODEL}' END AS reader,
  CASE WHEN refusal IS NULL THEN CASE WHEN right(document, 1) = '2' THEN 0 ELSE 1 END END AS proposals,
  CASE WHEN refusal IS NULL AND right(document, 1) <> '2' THEN length(text) || '  characters' END AS claim FROM r""",
    "assertion_readings": f"""WITH {_PARTS}, k AS (SELECT document, {i.claim_sql(i.concept_sql("'document'"), _SAID_OF_TEXT)} AS claim FROM readable WHERE right(document, 1) NOT IN ('0', '1', '2'))
SELECT {i.assertion_sql('claim', 'document', "''")} AS assertion, document, 1 AS passage, '{_LOCATION}' AS location, 'claims v1' AS protocol, '{_MODEL}' AS reader FROM k""",
    "request_fingerprints": f"""WITH {_PARTS} SELECT document, 1 AS passage, {_REQUEST} AS fingerprint, 'extractor' AS role, 2048 AS output_tokens,
  strlen(text)::INTEGER AS octets, {_PROTOCOL} AS protocol FROM readable""",
    "failed_runs": """SELECT DISTINCT document, 'unmet' AS coverage, 'an answer from the reader' AS needs FROM sources
WHERE document NOT IN (SELECT document FROM call_records WHERE outcome = 'answered' AND document IS NOT NULL)""",
    "coverage_records": """SELECT call_id AS seq, document, protocol, outcome FROM (SELECT DISTINCT call_id, document, protocol, outcome FROM call_records)
QUALIFY row_number() OVER (PARTITION BY document, protocol ORDER BY call_id DESC) = 1""",
    "coverage_values": f"""WITH {_READ} SELECT coverage, count(*) AS documents, coverage IN ('yielded', 'barren') AS has_run, coverage = 'barren' AS absence,
  CASE WHEN coverage = 'yielded' THEN sum(citations) ELSE 0 END::BIGINT AS findings FROM covered GROUP BY coverage""",
    "store_round_trip": f"""WITH {_DOCS} SELECT document, octet_length(content)::BIGINT AS length, CASE WHEN octet_length(content) = 0 THEN 'vacuous' ELSE 'stored' END AS admission,
  CASE WHEN octet_length(content) = 0 THEN 'vacuous' ELSE 'already present' END AS again, octet_length(content) > 0 AS held,
  CASE WHEN octet_length(content) > 0 THEN sha256(content) END AS digest FROM docs""",
    "log_round_trip": f"""SELECT row_number() OVER (ORDER BY arrival) AS seq, kind, coalesce(standing, '') AS standing, {_N("coalesce(successor, '')")} AS successor,
  {_N("coalesce(because, '')")} AS because, CASE WHEN kind = 'concept' THEN '' ELSE {_N("coalesce(ref, '')")} END AS ref, {_N("coalesce(text, '')")} AS text,
  '' AS source, '' AS scope, at_seconds AS "at" FROM publications WHERE lower(op) NOT IN ('d', 'delete')""",
    "torn_log": "SELECT * FROM (VALUES ('torn', true), ('missing', true)) v(log, refused)",
    "source_file": f"""WITH t AS (SELECT string_agg(r_name, chr(10) ORDER BY r_name) || chr(10) AS text FROM region)
SELECT {i.document_sql('encode(text)')} AS document, strlen(text)::INTEGER AS octets FROM t""",
    "log_replay": f"""WITH {_CITED_SQL} SELECT count(DISTINCT concept) AS concepts, count(DISTINCT claim) AS claims, count(DISTINCT assertion) AS citations,
  count(DISTINCT concept) AS held, NULL::BIGINT AS refused_at, NULL::VARCHAR AS error FROM cited""",
    "published_graph": f"""WITH {_CITED_SQL} SELECT DISTINCT {i.concept_sql('canonical_name')} AS concept, {_N('canonical_name')} AS canonical_name, 'asserted' AS standing FROM cited""",
    "workspace_admission": f"""WITH {_LINES}, links AS (SELECT *, {i.assertion_sql('claim', 'document', f"'{_SCOPE}'")} AS assertion FROM claimed),
corpus AS (SELECT count(DISTINCT concept) AS corpus_concepts, count(DISTINCT claim) AS corpus_claims, count(DISTINCT assertion) AS corpus_citations FROM links)
SELECT run, document AS source, CASE WHEN any_value(text) = '' THEN 'vacuous' ELSE 'stored' END AS admission, CASE WHEN count(assertion) > 0 THEN 'yielded' ELSE 'barren' END AS coverage,
  any_value(corpus_concepts) AS corpus_concepts, any_value(corpus_claims) AS corpus_claims, any_value(corpus_citations) AS corpus_citations,
  count(*) FILTER (assertion IS NULL) AS refused, count(assertion) - count(DISTINCT assertion) AS repeated, count(concept) - count(DISTINCT concept) AS merged, 0::BIGINT AS closed,
  'kept' AS documents, 'kept' AS knowledge FROM links, corpus GROUP BY run, document""",
    "workspace_reader": f"""WITH {_READ} SELECT document, 'lines' AS protocol, 'line reader' AS reader, coverage AS outcome,
  CASE WHEN coverage = 'yielded' THEN citations ELSE readings END AS amount, needs, 7::BIGINT AS "at" FROM covered""",
    "closings_recorded": f"""WITH {_NAMED} SELECT standing, CASE standing WHEN 'asserted' THEN '' WHEN 'reopened' THEN 'used again' ELSE 'no longer used' END AS because,
  CASE standing WHEN 'asserted' THEN 1 WHEN 'reopened' THEN 3 ELSE 2 END::BIGINT AS "at", count(*) AS concepts, count(*) FILTER (standing IN ('asserted', 'reopened')) AS current
FROM acts GROUP BY standing""",
    "current_neighbourhood": f"""WITH {_GRAPH}, top AS (SELECT concept FROM ck JOIN cc USING (concept) GROUP BY 1 ORDER BY count(*) DESC, concept LIMIT 1),
k AS (SELECT * FROM ck WHERE concept IN (SELECT concept FROM top))
SELECT 'concept' AS kind, concept AS id, canonical_name AS text FROM cc WHERE concept IN (SELECT concept FROM top)
UNION ALL SELECT 'claim', claim, text FROM k UNION ALL SELECT 'assertion', assertion, source FROM ca WHERE claim IN (SELECT claim FROM k)""",
    "historical_neighbourhood": f"""WITH {_GRAPH}, top AS (SELECT concept FROM gk JOIN gc USING (concept) GROUP BY 1 ORDER BY count(*) DESC, concept LIMIT 1),
k AS (SELECT * FROM gk WHERE concept IN (SELECT concept FROM top))
SELECT 'concept' AS kind, concept AS id, standing, standing = 'asserted' AS current FROM gc WHERE concept IN (SELECT concept FROM top)
UNION ALL SELECT 'claim', claim, standing, claim IN (SELECT claim FROM ck) FROM k
UNION ALL SELECT 'assertion', assertion, standing, assertion IN (SELECT assertion FROM ca) FROM ga WHERE claim IN (SELECT claim FROM k)""",
    "concept_counts": f"WITH {_GRAPH} SELECT 'current' AS world, count(*) AS concepts FROM cc UNION ALL SELECT 'historical', count(*) FROM gc",
    "answer_lines": f"""WITH {_GRAPH} SELECT 'search' AS tool, '{_WORDS}' AS argument, {_FOUND} AS answer
UNION ALL SELECT 'search', ' ', '(nothing)' UNION ALL SELECT 'merge_losers', '', {_LOSERS}""",
    "tool_session": f"""WITH {_GRAPH} SELECT id, code, failed, text FROM (VALUES (1, NULL::INTEGER, NULL::BOOLEAN, NULL::VARCHAR), (3, NULL, true, 'the argument is not text'),
  (4, NULL, true, 'no tool named unheard_of'), (5, -32602, NULL, NULL), (6, -32601, NULL, NULL), (7, NULL, false, '(nothing)'), (NULL, -32700, NULL, NULL)) v(id, code, failed, text)
UNION ALL SELECT 2, NULL, false, {_FOUND}""",
    "tool_catalogue": f"""WITH {_GRAPH} SELECT name, world, true AS takes_argument, true AS listed,
  'corpus     ' || (SELECT count(*) FROM cc) || ' current, ' || (SELECT count(*) FROM gc) || ' held' AS corpus
FROM (VALUES ('search', 'current'), ('get_concept', 'current'), ('neighbours', 'current'), ('merge_losers', 'historical'), ('held_neighbours', 'historical')) v(name, world)""",
    "derivation_parts": "SELECT DISTINCT " + i._sealed_sql(
        "reading", "'content'::BLOB", "'<opaque>'::BLOB", "unhex(sha256(content))", "'scope'::BLOB", "'<absent>'::BLOB", "'origin'::BLOB",
        f"""encode({_N("coalesce(origin, '')")})""",
    ) + """ AS identity, 'content scope origin' AS included,
  'arrival: when it came says nothing of what it is, length: the octets decide' AS excluded FROM sources WHERE content IS NOT NULL""",
    "scopes": f"""SELECT nullif({_N("coalesce(scope, '')")}, '') AS scope, count(*) AS assertions FROM assertions GROUP BY 1""",
    "promotions": f"""WITH {_GRAPH} SELECT DISTINCT {i.claim_sql('cc.concept', "'holds in general'")} AS artifact, assertion AS input, assertion AS identity_then
FROM cc JOIN ck USING (concept) JOIN ca USING (claim)""",
    "derivation_cycles": f"WITH RECURSIVE {_WALKS_SQL} SELECT DISTINCT concept AS artifact FROM walks WHERE concept = reached",
    "relation_algebra": """SELECT * FROM (VALUES ('resembles', 'transitive', 'required'), ('friend of', NULL, 'of no known kind'), ('like', 'transitive', 'forbidden'),
  ('same as', 'transitive', 'certified'), ('part of', 'transitive', 'certified')) v(relation, property, fault)""",
    "delete_permits": """SELECT protocol, model, CASE WHEN model IS NULL THEN 'not deterministic' WHEN NOT coalesce(bool_and(outcome = 'answered'), false) THEN 'inputs are not complete'
  WHEN NOT coalesce(bool_and(role = 'extractor'), false) THEN 'not scoped to derived rows' END AS refusal FROM call_records GROUP BY protocol, model""",
}


def _refused_sql() -> str:
    from stelae.plans.graph_queries import ORACLE as graph_sql

    return f"""SELECT NULL::BIGINT AS concepts, NULL::BIGINT AS claims, NULL::BIGINT AS citations, NULL::BIGINT AS held, seq AS refused_at, error
FROM ({graph_sql['replay_first_error']})"""


ORACLE["log_refused"] = _refused_sql()
