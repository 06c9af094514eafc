"""The five read tools: a question in, lines of text out.

Every tool returns a table ``section, id, line``; ``rendered`` orders it and joins
the lines, as a session shows them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelae.functions.identity import concept_identity
from stelae.functions.values import tool_argument
from stelae.operators.graph import KnowledgeGraph, is_current
from stelae.operators.retrieval import CurrentQueries, HistoricalQueries, attached

# How answers are worded.
CONCEPT, CLAIM, CITED = "concept  ", "claim    ", "cited    "
UNSTATED = "scope unstated"
NOTHING = "(nothing)"
NO_REASON = "no reason recorded"
CURRENT = "current"
CONCEPT_NOT_CURRENT = "not current: its concept is not"
CITED_NOT_CURRENT = "not current: what it cites is not"


class UnknownTool(ValueError):
    """A tool that is not served."""


def _lines(rows: DataFrame, section: int, key: str, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.col(key).alias("id"), line.alias("line"))


def standing_phrase() -> Column:
    """How a standing is said."""
    became = F.when(
        F.coalesce("successor", F.lit("")) != "", F.concat(F.lit("superseded by "), F.col("successor"))
    ).otherwise(F.lit("retired"))
    reason = F.coalesce("because", F.lit(""))
    closed = F.when(reason != "", F.concat_ws(": ", became, reason)).otherwise(became)
    return F.when(is_current(F.col("standing")), F.lit(CURRENT)).otherwise(closed)


def search(graph: KnowledgeGraph, argument: str) -> DataFrame:
    """Current claims that hold all words."""
    return _lines(CurrentQueries(graph).claims_matching(argument), 0, "claim", F.col("text"))


def get_concept(graph: KnowledgeGraph, argument: str) -> DataFrame:
    """Current concepts whose names hold all words."""
    return _lines(CurrentQueries(graph).concepts_matching(argument), 0, "concept", F.col("canonical_name"))


def neighbours(graph: KnowledgeGraph, argument: str) -> DataFrame:
    """A current concept, its claims and their citations.  The argument is compared
    with the canonical name as it is, not normalized."""
    world = graph.current()
    named = world.concepts().filter((F.col("canonical_name") == argument) & (F.lit(argument) != ""))
    claims, cited = attached(named, world.claims(), world.assertions())
    scope = F.when(F.col("scope") == "", F.lit(UNSTATED)).otherwise(F.col("scope"))
    return (
        _lines(named, 0, "concept", F.concat(F.lit(CONCEPT), "canonical_name"))
        .unionByName(_lines(claims, 1, "claim", F.concat(F.lit(CLAIM), "text")))
        .unionByName(
            _lines(cited, 2, "assertion", F.concat(F.lit(CITED), "source", F.lit(" ["), scope, F.lit("]")))
        )
    )


def merge_losers(graph: KnowledgeGraph, argument: str = "") -> DataFrame:
    """Superseded concepts, what they merged into, and why."""
    reason = F.when(F.coalesce("because", F.lit("")) == "", F.lit(NO_REASON)).otherwise(F.col("because"))
    into = F.when(F.coalesce("successor", F.lit("")) == "", F.lit("?")).otherwise(F.col("successor"))
    line = F.concat("canonical_name", F.lit(" -> "), into, F.lit(" ("), reason, F.lit(")"))
    return _lines(HistoricalQueries(graph).merge_losers(), 0, "concept", line)


def held_neighbours(graph: KnowledgeGraph, argument: str) -> DataFrame:
    """A held concept with everything ever attached to it, each with its standing.
    The argument is addressed as a concept, so it is normalized."""
    named, claims, cited = HistoricalQueries(graph).neighbourhood_of(concept_identity(F.lit(argument)))

    def said(rows: DataFrame, key: str, text: str, name: str, section: int, cause: str) -> DataFrame:
        phrase = (
            F.when(F.col("current"), F.lit(CURRENT)).when(is_current(F.col("standing")), F.lit(cause)).otherwise(standing_phrase())
        )
        return _lines(rows, section, key, F.concat(F.lit(name), F.col(text), F.lit(" ["), phrase, F.lit("]")))

    head = F.concat(F.lit(CONCEPT), "canonical_name", F.lit(" ["), standing_phrase(), F.lit("]"))
    return (
        _lines(named, 0, "concept", head)
        .unionByName(said(claims, "claim", "text", CLAIM, 1, CONCEPT_NOT_CURRENT))
        .unionByName(said(cited, "assertion", "source", CITED, 2, CITED_NOT_CURRENT))
    )


TOOLS: dict[str, tuple[str, str, Callable[[KnowledgeGraph, str], DataFrame]]] = {
    "search": ("current", "claims that hold every word", search),
    "get_concept": ("current", "concepts whose names hold every word", get_concept),
    "neighbours": ("current", "a concept, its claims and their citations", neighbours),
    "merge_losers": ("historical", "superseded concepts and what they became", merge_losers),
    "held_neighbours": ("historical", "everything ever attached to a concept", held_neighbours),
}


SERVER, PROTOCOL = "stelae", "2.0"
#: The one argument every tool takes; a tool that needs none is asked without it.
SCHEMA = {"type": "object", "properties": {"argument": {"type": "string", "description": "the question"}}}


def server() -> dict:
    """Name and version of what serves the tools."""
    import stelae

    return {"name": SERVER, "version": stelae.__version__}


def catalogue() -> list[dict]:
    """Tool descriptions as a session lists them."""
    return [
        {"name": name, "description": f"[{world}] {summary}", "inputSchema": SCHEMA}
        for name, (world, summary, _) in TOOLS.items()
    ]


def answer(graph: KnowledgeGraph, tool: str, argument: str = "") -> DataFrame:
    """``section, id, line`` of a tool's answer; an unknown tool is refused."""
    if tool not in TOOLS:
        raise UnknownTool(f"no tool named {tool}")
    return TOOLS[tool][2](graph, argument)


def rendered(lines: DataFrame) -> str:
    """The answer as text, ``(nothing)`` if there is none.  It is what a person
    reads, so it is brought to the driver whole."""
    found = [r.line for r in lines.orderBy("section", "id").collect()]
    return "\n".join(found) or NOTHING


def call(graph: KnowledgeGraph, tool: str, arguments: str) -> dict:
    """One call of a session, with JSON arguments; a bad argument is a failed call
    and not the end of the session."""
    try:
        return {"isError": False, "text": rendered(answer(graph, tool, tool_argument(arguments)))}
    except ValueError as error:
        return {"isError": True, "text": str(error)}


def surface(graph: KnowledgeGraph) -> DataFrame:
    """Concepts that are current and concepts that are held."""
    return graph.concepts.agg(
        F.count_if(is_current(F.col("standing"))).alias("current"), F.count("*").alias("held")
    )


def listing(graph: KnowledgeGraph) -> str:
    """What is served, over what, and what is not: the tools with their worlds, the corpus and
    the absences."""
    counted = surface(graph).first()
    lines = [f"{SERVER}: {len(TOOLS)} read-only tools"]
    lines += [f"  {name:<16}[{world}]  {summary}" for name, (world, summary, _) in TOOLS.items()]
    lines += ["", f"corpus     {counted.current} current, {counted.held} held", "", *ABSENCES]
    return "\n".join(lines)


ABSENCES = (
    "No tool writes: each reads one of two worlds that have no way to.",
    "No paths and no connections: relations between concepts have no declared kinds in the log.",
    "No proofs and no code: the log has no such records.",
    "No ranking: answers are whole and in order of identity.",
)


def respond(graph: KnowledgeGraph, line: str) -> str | None:
    """One line of a session, a JSON-RPC request, answered; None for a notification.

    A line that is no JSON, no request or of an unknown method is answered with an error, and
    the session goes on; a tool that fails is an answer that says so.
    """
    try:
        request = json.loads(line)
    except json.JSONDecodeError:
        return _reply(None, error=(-32700, "the line is not JSON"))
    if not isinstance(request, dict) or request.get("jsonrpc") != PROTOCOL or not isinstance(request.get("method"), str):
        return _reply(request.get("id") if isinstance(request, dict) else None, error=(-32600, "the line is no request"))
    if "id" not in request:
        return None
    method, params = request["method"], request.get("params") or {}
    if method == "initialize":
        return _reply(request["id"], {"serverInfo": server(), "capabilities": {"tools": {}}})
    if method == "tools/list":
        return _reply(request["id"], {"tools": catalogue()})
    if method == "tools/call" and isinstance(params, dict) and isinstance(params.get("name"), str):
        done = call(graph, params["name"], json.dumps(params.get("arguments") or {}))
        return _reply(request["id"], {"content": [{"type": "text", "text": done["text"]}], "isError": done["isError"]})
    known = method == "tools/call"
    return _reply(request["id"], error=(-32602, "a call names a tool") if known else (-32601, f"no method named {method}"))


def _reply(identity, result: dict | None = None, error: tuple[int, str] | None = None) -> str:
    body = {"result": result} if error is None else {"error": {"code": error[0], "message": error[1]}}
    return json.dumps({"jsonrpc": PROTOCOL, "id": identity, **body})


def session(graph: KnowledgeGraph, lines: Iterable[str]) -> Iterator[str]:
    """Answers to the lines of a session, blank lines passed over; over standard input and
    output: ``for a in session(graph, sys.stdin): print(a, flush=True)``."""
    for line in lines:
        reply = respond(graph, line) if line.strip() else None
        if reply is not None:
            yield reply
