"""The fold against a sequential replay, the worlds and the tools."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stelae.functions.normalize import normalized_text
from stelae.operators import graph, history, tools
from stelae.operators.graph import LOG, KnowledgeGraph, ReplayRefused

HEX = re.compile(r"[0-9a-f]{64}")


def seal(*parts):
    return hashlib.sha256(b"".join((p if isinstance(p, bytes) else p.encode()) + b"\x1f" for p in parts)).hexdigest()


def concept_id(name):
    return seal("kind", "concept", "canonical_name", normalized_text(name))


def claim_id(ref, text):
    return seal("kind", "claim", "concept", "<identity>", bytes.fromhex(ref), "text", normalized_text(text))


def assertion_id(ref, source, scope):
    return seal("kind", "assertion", "claim", "<identity>", bytes.fromhex(ref), "source", normalized_text(source), "scope", normalized_text(scope))


def legal(standing, successor, because):
    return (
        (standing, successor, because) == ("asserted", "", "")
        or (standing == "retired" and not successor and bool(because))
        or (standing == "superseded" and bool(HEX.fullmatch(successor)) and bool(because))
    )


def sequential(log):
    """First error as (seq, kind of error), and the held values."""
    held = {"concept": {}, "claim": {}, "assertion": {}}
    parent = {"claim": "concept", "assertion": "claim"}
    for seq, kind, standing, successor, because, ref, text, source, scope, _ in log:
        if kind not in held:
            return (seq, "malformed"), held
        if kind != "concept":
            if not HEX.fullmatch(ref):
                return (seq, "unaddressed"), held
            if ref not in held[parent[kind]]:
                return (seq, "out of order"), held
        if not legal(standing, successor, because):
            return (seq, "malformed"), held
        key = concept_id(text) if kind == "concept" else claim_id(ref, text) if kind == "claim" else assertion_id(ref, source, scope)
        held[kind][key] = (standing, successor, because)
    return None, held


def random_log(rng, n, faults):
    names = ["alpha", "beta ", " gamma", "de\u0001lta"]
    log, claims = [], []
    if not faults:  # parents first, so that the log replays
        log = [(k, "concept", "asserted", "", "", "", name, "", "", None) for k, name in enumerate(names, 1)]
        claims.append(claim_id(concept_id("beta"), "first"))
        log.append((5, "claim", "asserted", "", "", concept_id("beta"), "first", "", "", None))
    for seq in range(len(log) + 1, n + 1):
        kind = rng.choice(["concept", "concept", "claim", "claim", "assertion"])
        standing = rng.choice([("asserted", "", "")] * 4 + [("retired", "", "why"), ("superseded", concept_id("beta"), "why")])
        if rng.random() < faults:
            standing = rng.choice([("asserted", "", "x"), ("retired", "", ""), ("superseded", "beta", "why"), ("gone", "", "")])
        ref = text = source = scope = ""
        if kind == "concept":
            text = rng.choice(names)
        elif kind == "claim":
            ref, text = concept_id(rng.choice(names)), rng.choice(["one", "two", " two"])
            claims.append(claim_id(ref, text))
        else:
            ref, source, scope = rng.choice(claims or ["x"]), rng.choice(["s1", "s2"]), rng.choice(["", "physics"])
        if rng.random() < faults and kind != "concept":
            ref = rng.choice(["", "zz", ref.upper(), ref[:-1]])
        if rng.random() < faults / 3:
            kind = "theorem"
        log.append((seq, kind, *standing, ref, text, source, scope, rng.choice([None, seq * 10])))
    return log


def test_fold_equals_sequential_replay(spark):
    refused = 0
    for seed in range(10):
        rng = random.Random(seed)
        log = random_log(rng, 40, 0.08 if seed % 2 else 0.0)
        df = spark.createDataFrame(log, LOG)
        error, held = sequential(log)
        first = graph.first_violation(df).collect()
        assert ((first[0].seq, first[0].error) if first else None) == error, seed
        if error:
            refused += 1
            with pytest.raises(ReplayRefused):
                KnowledgeGraph.replayed(df)
            df = df.filter(F.col("seq") < error[0])
        folded = KnowledgeGraph.replayed(df)
        for kind, table in (("concept", folded.concepts), ("claim", folded.claims), ("assertion", folded.assertions)):
            got = {r[0]: (r.standing, r.successor, r.because) for r in table.collect()}
            assert got == held[kind], (seed, kind)
    assert 0 < refused < 10


def test_records_as_text(spark, rows):
    us = "\x1f"
    lines = [
        us.join(["concept", "asserted", "", "", "entropy"]),
        us.join(["concept", "asserted", "", "", "entropy", "1730000000"]),
        us.join(["claim", "asserted", "", "", concept_id("entropy"), "It is non-decreasing."]),
        us.join(["assertion", "asserted", "", "", "x" * 64, "Callen", "1985"]),
        us.join(["assertion", "asserted", "", "", "x" * 64, "Callen", "", "1985"]),
        us.join(["concept", "asserted", "", "entropy"]),
        us.join(["concept", "asserted", "", "", "a", "b"]),
        us.join(["theorem", "asserted", "", "", "a"]),
        "",
    ]
    parsed = graph.parsed(spark.createDataFrame(list(enumerate(lines, 1)), "seq long, record string"))
    got = {r.seq: (r.shaped, r.at, r.scope) for r in parsed.collect()}
    assert [got[n][0] for n in range(1, 10)] == [True, True, True, True, True, False, False, False, False]
    assert got[2][1] == 1730000000 and got[4] == (True, None, "1985") and got[5] == (True, 1985, "")
    again = graph.rendered(parsed.filter("shaped")).collect()
    assert {r.seq: r.record for r in again} == {n: lines[n - 1] for n in range(1, 6)}
    bad = {r.seq: r.error for r in graph.violations(parsed).collect()}
    assert bad == {4: "unaddressed", 5: "unaddressed", 6: "malformed", 7: "malformed", 8: "malformed", 9: "malformed"}


def merged_corpus(spark):
    """A concept merged into another, with a claim and a citation, and one that stands."""
    lost, kept = concept_id("phlogiston"), concept_id("oxidation")
    claim, other = claim_id(lost, "It is released in combustion."), claim_id(kept, "It takes oxygen.")
    log = [
        (1, "concept", "asserted", "", "", "", "phlogiston", "", "", 10),
        (2, "concept", "asserted", "", "", "", "oxidation", "", "", 20),
        (3, "claim", "asserted", "", "", lost, "It is released in combustion.", "", "", 15),
        (4, "assertion", "asserted", "", "", claim, "", "Stahl 1703", "chemistry", None),
        (5, "claim", "asserted", "", "", kept, "It takes oxygen.", "", "", 30),
        (6, "assertion", "asserted", "", "", other, "", "Lavoisier", "", 30),
        (7, "concept", "superseded", kept, "superseded by oxidation theory", "", "phlogiston", "", "", 40),
    ]
    return spark.createDataFrame(log, LOG), kept


def test_worlds(spark, rows):
    log, kept = merged_corpus(spark)
    held = KnowledgeGraph.replayed(log)
    now = held.current()
    assert [r.canonical_name for r in now.concepts().collect()] == ["oxidation"]
    assert [r.text for r in now.claims().collect()] == ["It takes oxygen."]
    assert [r.source for r in now.assertions().collect()] == ["Lavoisier"]
    ever = held.every_version()
    assert (ever.concepts().count(), ever.claims().count(), ever.assertions().count()) == (2, 2, 2)
    assert [r.canonical_name for r in ever.merge_losers().collect()] == ["phlogiston"]


def test_tool_lines(spark):
    log, kept = merged_corpus(spark)
    held = KnowledgeGraph.replayed(log)
    say = lambda tool, argument="": tools.rendered(tools.answer(held, tool, argument))
    assert say("search", "takes oxy") == "It takes oxygen."
    assert say("search", "combustion") == say("search", "") == say("neighbours", "phlogiston") == "(nothing)"
    assert say("get_concept", "dation") == "oxidation"
    assert say("neighbours", "oxidation") == "concept  oxidation\nclaim    It takes oxygen.\ncited    Lavoisier [scope unstated]"
    assert say("neighbours", " oxidation") == "(nothing)"  # compared as it is
    assert say("merge_losers") == f"phlogiston -> {kept} (superseded by oxidation theory)"
    assert say("held_neighbours", " phlogiston\n") == (
        f"concept  phlogiston [superseded by {kept}: superseded by oxidation theory]\n"
        "claim    It is released in combustion. [not current: its concept is not]\n"
        "cited    Stahl 1703 [not current: what it cites is not]"
    )
    assert say("held_neighbours", "unheard of") == "(nothing)"
    assert [tuple(r) for r in tools.surface(held).collect()] == [(1, 2)]
    with pytest.raises(tools.UnknownTool):
        tools.answer(held, "delete")
    assert tools.call(held, "search", '{"argument": 3}')["isError"]
    assert tools.call(held, "search", '{"argument": "oxygen"}') == {"isError": False, "text": "It takes oxygen."}
    assert [t["name"] for t in tools.catalogue()] == ["search", "get_concept", "neighbours", "merge_losers", "held_neighbours"]


def test_history_is_a_prefix(spark):
    log, _ = merged_corpus(spark)
    count = lambda df: tuple(history.counts(df).first())
    assert count(log) == (1, 1, 1, 2)
    assert count(history.through(log, 4)) == (2, 1, 1, 2)
    assert count(history.through(log, 0)) == (0, 0, 0, 0)
    with pytest.raises(history.HistoryRefused):
        history.through(log, 8)
    # Record 3 has time 15 but follows one of time 20: as of 15 it is not reached.
    assert [r.seq for r in history.as_of(log, 15).orderBy("seq").collect()] == [1]
    assert [r.seq for r in history.as_of(log, 20).orderBy("seq").collect()] == [1, 2, 3, 4]
    assert history.as_of(log, 99).count() == 7
    with pytest.raises(history.HistoryRefused):
        history.as_of(log.withColumn("at", F.lit(None).cast("long")), 5)
    with pytest.raises(history.HistoryRefused):
        history.as_of(graph.empty_log(spark), 5)


def test_tables_as_graph(spark):
    concepts = spark.createDataFrame(
        [("a", " A ", "asserted", "", None, 1, None, 1), ("a", " A ", "retired", None, "why", 2, None, 2), ("b", None, "asserted", None, None, None, 5, 1), (None, "x", None, None, None, None, None, None)],
        "concept string, canonical_name string, standing string, successor string, because string, at_seconds long, removed_at long, loaded_at long",
    )
    claims = spark.createDataFrame([("k", "a", "t", "asserted", 1, None, 1)], "claim string, concept string, text string, standing string, at_seconds long, removed_at long, loaded_at long")
    cited = spark.createDataFrame([], "assertion string, claim string, source string, scope string, standing string, at_seconds long, loaded_at long")
    held = KnowledgeGraph.of_tables(concepts, claims, cited)
    assert [tuple(r) for r in held.concepts.collect()] == [("a", "A", "retired", "", "why")]
    assert held.current().claims().count() == 0 and held.claims.count() == 1


def test_replay_in_one_plan_equals_the_sequential_one(spark):
    for seed in range(4):
        log = random_log(random.Random(seed), 30, 0.08 if seed % 2 else 0.0)
        df = spark.createDataFrame(log, LOG)
        error, held = sequential(log)
        row = history.replay(df).first()
        if error:
            assert (row.refused_at, row.error) == error and row.concepts is None
        else:
            counts = history.counts(df).first()
            assert (row.concepts, row.claims, row.citations, row.held) == tuple(counts) and row.held == len(held["concept"])
    empty = history.replay(graph.empty_log(spark)).first()
    assert (empty.concepts, empty.held, empty.refused_at) == (0, 0, None)


def test_a_session_survives_every_line(spark):
    log = spark.createDataFrame([(1, "concept", "asserted", "", "", "", "entropy", "", "", None)], LOG)
    held = KnowledgeGraph.folded(log)
    lines = ['{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}', "", "[]", '{"id": 2}', '{"jsonrpc": "2.0", "method": "note"}',
             '{"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_concept", "arguments": {"argument": "ent"}}}',
             '{"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": [1]}']
    replies = [json.loads(r) for r in tools.session(held, lines)]
    assert [r["id"] for r in replies] == [1, None, 2, 3, 4]
    assert [t["name"] for t in replies[0]["result"]["tools"]] == list(tools.TOOLS)
    assert [r.get("error", {}).get("code") for r in replies] == [None, -32600, -32600, None, -32602]
    assert replies[3]["result"] == {"content": [{"type": "text", "text": "entropy"}], "isError": False}
    listed = tools.listing(held)
    assert "corpus     1 current, 1 held" in listed and all(name in listed for name in tools.TOOLS)
