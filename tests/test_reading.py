import json
import random

from pyspark.sql import functions as F

from stelae.operators import admission, audit, reading
from stelae.operators.ordered import previous, running


def test_recorded_answers(spark, rows):
    documents = spark.createDataFrame(
        [(f"d{n}", c) for n, c in enumerate([b"good", b"bad", b"unasked", b"\xff\xfe", b"", b"empty list"])], "document string, content binary"
    )
    parts = reading.passages(documents)
    assert {r.document: r.readable for r in parts.collect()} == {"d0": True, "d1": True, "d2": True, "d3": False, "d4": False, "d5": True}
    assert parts.first().location == "pages 1 to 1 of the text"
    key = {r.text: r.f for r in parts.select("text", reading.fingerprint("m", "i", F.coalesce("text", F.lit(""))).alias("f")).collect()}
    answers = {"good": json.dumps([{"concept": "c", "claim": "t", "more": 1}]), "bad": json.dumps([{"concept": "c"}]), "empty list": "[]"}
    recordings = spark.createDataFrame([(key[k], v) for k, v in answers.items()], "fingerprint string, answer string")
    read, refused = reading.recorded_readings(parts, recordings, "m", "i", "p")
    assert {(r.document, tuple(map(tuple, r.proposed))) for r in read.collect()} == {("d0", (("c", "t"),)), ("d5", ())}
    assert rows(refused) == [
        ("d1", "reader failed", "an answer from the reader"), ("d2", "reader failed", "an answer from the reader"),
        ("d3", "cannot read", "a reading this extractor cannot do"), ("d4", "cannot read", "a reading this extractor cannot do"),
    ]


def test_answer_shapes(spark):
    one = {"concept": "c", "claim": "t"}
    given = [[one] * 32, [one] * 33, 5, None, {"a": 1}, [{"concept": 1, "claim": "t"}], [one, {"claim": "t"}], [{"concept": None, "claim": "t"}], [3], "text"]
    df = spark.createDataFrame([(n, json.dumps(g)) for n, g in enumerate(given)] + [(10, "{"), (11, None)], "n int, a string")
    got = [r.f for r in df.select("n", reading.answer_fault(F.col("a")).alias("f")).orderBy("n").collect()]
    field = "a proposition lacks a text field"
    assert got[:3] == [None, "too many propositions", "not a sequence"] and got[4:10] == ["not a sequence", field, field, field, field, "not a sequence"]
    assert got[3] is not None and got[10:] == ["not JSON", "no answer"]


def readers():
    """Made here, so that the tasks get them by value."""

    def words_of_text(document, content, needed):
        return [reading.Reading(document, "all of it", [(w, document) for w in content.decode().split()])]

    def moody(document, content, needed):
        """Fails, refuses, answers for another document, says nothing, or reads."""
        if needed != reading.TEXT or content == b"picture":
            raise reading.CannotRead("not text")
        if content == b"broken":
            raise RuntimeError("no connection")
        if content == b"none":
            return []
        if content == b"astray":
            return [reading.Reading(document, "p", [("c", "t")]), reading.Reading("another", "p", [("c", "t")])]
        if content == b"shapeless":
            return [("only", "two")]
        return [reading.Reading(document, f"p{n}", [] if content == b"barren" else [("c", f"t{n}")]) for n in range(2)]

    return words_of_text, moody


def test_every_outcome_of_a_reader(spark, rows):
    kinds = [b"picture", b"broken", b"none", b"astray", b"shapeless", b"barren", b"fine"]
    documents = spark.createDataFrame([(k.decode(), k) for k in kinds], "document string, content binary")
    given, refused = reading.answered(reading.read_with(readers()[1], documents, "p", "r"))
    outcome = reading.examined(documents, given, refused)
    want = {
        "picture": (0, "cannot read", "a reading this extractor cannot do"), "broken": (0, "reader failed", "an answer from the reader"),
        "none": (0, None, "the reader returned no reading"), "astray": (0, "reader failed", "an answer from the reader"),
        "shapeless": (0, "reader failed", "an answer from the reader"), "barren": (2, None, None), "fine": (2, None, None),
    }
    assert {r.document: (r.readings, r.refusal, r.needs) for r in outcome.collect()} == want
    runs = outcome.withColumn("run", F.lit(1).cast("long"))
    said = reading.statements(reading.accepted(given, outcome), runs)
    got = {r.document: (r.coverage, r.citations) for r in admission.report(said, runs).collect()}
    assert got == {**{k: ("unmet", 0) for k in ("picture", "broken", "none", "astray", "shapeless")}, "barren": ("barren", 0), "fine": ("yielded", 2)}
    seen = reading.read_with(readers()[1], documents, "p", "r", needed=reading.VISUAL)
    assert {r.refusal for r in seen.collect()} == {"cannot read"}
    unread = reading.examined(documents)
    assert {(r.refusal, r.needs) for r in unread.collect()} == {("not read", "a reader")}
    facts = rows(reading.lineage(reading.accepted(given, outcome)).select("document", "passage", "location", "protocol", "reader"))
    assert facts == [("fine", 1, "p0", "p", "r"), ("fine", 2, "p1", "p", "r")]


def test_requests_protocols_prices_and_retries(spark, rows):
    parts = reading.passages(spark.createDataFrame([("d", b"text"), ("e", b"\xff")], "document string, content binary"))
    asked = reading.requests(parts, "m", "i").collect()
    assert [(r.document, r.request.role, r.request.content, r.request.output_tokens) for r in asked] == [("d", "extractor", "text", 2048)]
    assert json.loads(asked[0].request.schema)["maxItems"] == 32
    versions = spark.range(1).select(reading.protocol_identity("i").alias("a"), reading.protocol_identity("j").alias("b"), reading.protocol_identity("i", "{}").alias("c")).first()
    assert len(set(versions)) == 3
    good = json.dumps([{"concept": "c", "claim": "t"}])
    attempts = spark.createDataFrame([("d", 1, 1, "{"), ("d", 1, 2, good), ("d", 1, 3, "never"), ("d", 2, 1, None), ("d", 2, 2, "5"), ("d", 2, 3, good)], "document string, passage int, attempt int, answer string")
    assert rows(reading.retried(attempts, 2)) == [("d", 1, 1, 1, good), ("d", 2, 2, 0, None)]
    usage = spark.createDataFrame([(1_000_000, 500_000), (3, None)], "input long, output long")
    assert [r.cost_micros for r in reading.priced(usage, {"input": 3, "output": 15}).collect()] == [10, None]


def test_stated_and_function_readers(spark, rows):
    said = spark.createDataFrame([("d", "here", 2, "c2", "t2"), ("d", "here", 1, "c1", "t1")], "document string, location string, ordinal int, concept_name string, claim_text string")
    stated = reading.stated_readings(said)
    assert [tuple(p) for p in stated.first().proposed] == [("c1", "t1"), ("c2", "t2")]
    documents = spark.createDataFrame([("d", b"a b")], "document string, content binary")
    read, refused = reading.answered(reading.read_with(readers()[0], documents, "words", "splitter"))
    assert refused.count() == 0
    runs = spark.createDataFrame([(7, "d")], "run long, document string")
    flat = reading.statements(read, runs)
    assert rows(flat) == [(7, "d", "", 1, 0, "a", "d"), (7, "d", "", 1, 1, "b", "d")]
    handed = spark.createDataFrame([("d", "d"), ("e", "x"), ("f", None)], "asked string, document string")
    assert rows(reading.misdirected(handed)) == [("e",), ("f",)]


def test_budget_and_measures(spark):
    requests = spark.createDataFrame(
        [("d", 1, True, True, 1), ("d", 2, True, True, 1), ("d", 3, True, False, None), ("e", 1, True, False, 0), ("e", 2, False, False, None)],
        "document string, passage int, answered boolean, well_formed boolean, cost_micros long",
    )
    got = {(r.document, r.passage): r.judged for r in reading.outcomes(requests, 2).collect()}
    assert got == {("d", 1): "answered", ("d", 2): "budget-exhausted", ("d", 3): "budget-exhausted", ("e", 1): "malformed", ("e", 2): "abandoned"}
    ledger = spark.createDataFrame([("d", 1, 1, 1, 5, 2, 10), ("d", 2, 2, 0, 5, 2, 10), ("d", 3, 0, 1, 9, 3, 12)], "document string, passage int, failed int, answered int, input long, output long, cost_micros long")
    rows = [tuple(r)[1:] for r in reading.measures(ledger).orderBy("passage").collect()]
    assert rows == [(1, 2, 5, 2, 10), (2, 2, None, None, None), (3, 1, 4, 1, 2)]
    assert {r.cost_micros for r in reading.measures(ledger, priced=False).collect()} == {None}


def test_call_records(spark):
    schema = "call_id long, role string, model string, protocol string, document string, outcome string, attempts long, input long, output long, cache_read long, cache_write long, cost_micros long, wait_nanos long"
    h = "0" * 64
    calls = [
        (1, "extractor", "m", "p", h, "answered", 1, 1, 2, 3, 4, 5, 6), (2, "extractor", "m", "p", h, "abandoned", 3, None, None, None, None, None, 0),
        (3, "extractor", "m\t", "p", h, "answered", 1, 1, 2, 3, 4, 5, 6), (4, "extractor", "m", "p", h, "answered", 1, 1, None, 3, 4, 5, 6),
        (5, "extractor", "m", "p", "h", "answered", 1, 1, 2, 3, 4, 5, 6), (6, "extractor", "m", "p", h, "odd", 1, 1, 2, 3, 4, 5, 6),
    ]
    written = reading.rendered_calls(spark.createDataFrame(calls, schema))
    text = {r.call_id: (r.record, r.fault) for r in written.collect()}
    assert text[2][0].split("\x1f")[7:] == ["-", "-", "-", "-", "-", "0"]
    assert text[3] == (None, "empty or control-bearing text") and text[4] == (None, "partial token counts")
    read = {r.call_id: (r.fault, r.attempts, r.input) for r in reading.parsed_calls(written).collect()}
    assert read == {1: (None, 1, 1), 2: (None, 3, None), 5: ("invalid source identity", None, None), 6: ("unknown outcome", None, None)}
    broken = spark.createDataFrame([(1, "a\x1fb"), (2, text[1][0].replace("call-v1", "call-v0")), (3, text[1][0][:-1] + "x")], "call_id long, record string")
    assert [r.fault for r in reading.parsed_calls(broken).orderBy("call_id").collect()] == ["wrong field count", "unsupported version", "invalid wait"]


def test_grounding(spark):
    df = spark.createDataFrame([("a  b", "x a\nb y"), ("ab", "a b"), (" ", "x"), (None, None)], "quote string, passage_text string")
    assert [r.grounded for r in reading.grounded(df).collect()] == [True, False, False, False]


def test_running_and_previous_across_ranges(spark):
    rng = random.Random(4)
    data = [(rng.choice(["g", "h", None]), rng.choice([None, *range(0, 400_000, 9_000)]), rng.choice([None, 1, 2, 5])) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    low = lambda o: -1 if o is None else o
    summed = {(g, o): s for g, o, _, s in (tuple(r) for r in running(df, "g", "o", F.col("v"), "s").collect())}
    for (g, o), s in summed.items():
        assert s == sum(v or 0 for a, b, v in data if a == g and low(b) <= low(o))
    for g, o, _, p in (tuple(r) for r in previous(df, "g", "o", F.col("v"), "p").collect()):
        before = [(low(b), v) for a, b, v in data if a == g and low(b) < low(o) and v is not None]
        assert p == (max(before)[1] if before else None)


def test_audits(spark, rows):
    derived = spark.createDataFrame([("b", "a", "1"), ("c", "b", "1"), ("d", "c", "1"), ("e", "gone", "1"), ("f", "ok", "1"), ("g", "f", "1"), ("h", "e", "1")], "artifact string, input string, identity_then string")
    now = spark.createDataFrame([("a", "2"), ("ok", "1"), *((x, "1") for x in "bcdefgh")], "input string, identity_now string")
    assert [(r.artifact, r.status, " ".join(r.path)) for r in audit.stale(derived, now).orderBy("artifact").collect()] == [
        ("b", "stale", "b a"), ("c", "propagated", "c b a"), ("d", "propagated", "d c b a"), ("e", "unsupported", "e gone"),
        ("f", "sound", ""), ("g", "sound", ""), ("h", "propagated", "h e gone"),
    ]
    assert audit.closes_cycle(derived, "a", ["d"]) and not audit.closes_cycle(derived, "z", ["d"]) and audit.closes_cycle(derived, "d", ["d"])
    proposed = spark.createDataFrame([("a", "d", "1"), ("x", "y", "1"), ("y", "x", "1"), ("z", "b", "1")], "artifact string, input string, identity_then string")
    kept, refused = audit.derive(derived, proposed)
    assert rows(refused) == [("a",), ("x",), ("y",)] and rows(kept.join(derived, derived.columns, "left_anti")) == [("z", "b", "1")]
    log = spark.createDataFrame([(1, "d", "p", "unmet"), (2, "d", "p", "yielded"), (1, "e", "q", "barren")], "seq long, document string, protocol string, outcome string")
    assert rows(audit.latest_coverage(log).select("document", "outcome")) == [("d", "yielded"), ("e", "barren")]
    held = spark.createDataFrame([("d",), ("e",), ("e",)], "document string")
    assert rows(audit.uncovered(held, log, "p")) == [("e",)]
    parts = spark.createDataFrame([("d", True), ("d", False), ("e", False), ("f", True)], "document string, readable boolean")
    assert rows(audit.by_fidelity(parts)) == [("d", "skipped"), ("e", "unmet"), ("f", None)]
    cases = spark.createDataFrame([(0, 0, 0), (2, 1, 1), (2, 2, 1), (2, 2, 0)], "eligible int, examined int, found int")
    judged = cases.select(audit.verdict(F.col("eligible"), F.col("examined"), F.col("found")).alias("verdict"))
    assert [r.verdict for r in judged.collect()] == ["vacuous", "blind", "failed", "clean"]
    assert rows(audit.overall(judged)) == [("blind", 3)] and rows(audit.overall(judged.filter("verdict IN ('clean', 'vacuous')"))) == [("vacuous", 4)]


def test_permitted_deletes(spark):
    jobs = spark.createDataFrame([(True, True, True), (None, True, True), (True, False, True), (True, True, None)], "deterministic boolean, inputs_complete boolean, scoped_to_derived boolean")
    want = [None, "not deterministic", "inputs are not complete", "not scoped to derived rows"]
    assert [r.refusal for r in audit.permitted_deletes(jobs).collect()] == want


def test_every_protocol_is_audited(spark, rows):
    held = spark.createDataFrame([("d",), ("e",), ("e",)], "document string")
    log = spark.createDataFrame([("d", "p"), ("e", "q"), ("d", None)], "document string, protocol string")
    assert rows(audit.uncovered_by_protocol(held, log)) == [("d", "q"), ("e", "p")]


def test_every_claim_has_a_grounding(spark, tmp_path):
    from stelae.plans.reading_queries import grounded_texts

    spark.createDataFrame([("c", "Iron ore"), ("d", "Iron ore")], "concept string, canonical_name string").write.parquet(f"{tmp_path}/concepts.parquet")
    claims = [("1", "c", "Iron  ore"), ("2", "d", "no iron ore"), ("3", "gone", "ore"), ("4", None, None)]
    spark.createDataFrame(claims, "claim string, concept string, text string").write.parquet(f"{tmp_path}/claims.parquet")
    got = {r.claim: r.grounded for r in grounded_texts(spark, str(tmp_path)).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": False}
