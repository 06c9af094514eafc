"""Admission, stores, closing and the log, end to end."""

import os

import pytest
from pyspark.sql import functions as F

from stelae.operators import admission, closing
from stelae.operators.graph import KnowledgeGraph
from stelae.operators.reading import Reading
from stelae.operators.workspace import Refused, Workspace
from stelae.session import Scratch
from stelae.sources import content_store, record_log

SAID = "run long, ordinal int, concept_name string, claim_text string"


def sources(spark, *texts):
    return spark.createDataFrame([(n, t.encode()) for n, t in enumerate(texts)], "run long, content binary")


def said(spark, *proposals):
    return spark.createDataFrame([(r, n, c, t) for n, (r, c, t) in enumerate(proposals)], SAID)


@pytest.fixture(params=["kept", "memory"])
def workspace(request, spark, tmp_path):
    return Workspace(spark, str(tmp_path / "store") if request.param == "kept" else None)


def test_two_sources_one_claim(spark, workspace):
    text = "It does not decrease in an isolated system."
    got = workspace.admit(
        sources(spark, "by one author", "by another"),
        said(spark, (0, "entropy", text), (1, " entropy", text + "\n"), (1, "entropy", text), (1, "", "x"), (1, None, "y")),
        at=1,
    ).orderBy("run").collect()
    assert [(r.coverage, r.refused, r.repeated, r.merged, r.closed) for r in got] == [("yielded", 0, 0, 0, 0), ("yielded", 2, 1, 1, 0)]
    assert {(r.corpus_concepts, r.corpus_claims, r.corpus_citations) for r in got} == {(1, 1, 2)}
    assert {r.admission for r in got} == {"stored"} and {r.knowledge for r in got} == {workspace.kept()}
    assert workspace.log().count() == 6  # a later run publishes its concept and claim again
    assert sorted(r.seq for r in workspace.log().collect()) == [1, 2, 3, 4, 5, 6]
    again = workspace.admit(sources(spark, "by one author"), said(spark, (0, "entropy", text)))
    assert [(r.admission, r.repeated) for r in again.collect()] == [("already present", 0)]


def test_no_reader_still_stores(spark, workspace):
    got = workspace.admit(sources(spark, "unread", ""), None).orderBy("run").collect()
    assert [(r.coverage, r.needs, r.admission) for r in got] == [("unmet", "a reader", "stored"), ("unmet", "a reader", "vacuous")]
    assert workspace.store.length() == 1 and not workspace.store.is_empty() and workspace.log().count() == 0
    address = workspace.store.identities().first().document
    assert workspace.store.read(address) == b"unread"
    with pytest.raises(content_store.NoSuchDocument):
        workspace.store.read("0" * 64)
    with pytest.raises(Refused):
        workspace.admit(sources(spark, "x"), None, scope=" \u0001")


def test_closing_guards_and_closed_admission(spark, workspace):
    workspace.admit(sources(spark, "d"), said(spark, (0, "alpha", "a"), (0, "beta", "b")), at=1)
    before = workspace.log().count()
    refusals = [
        (lambda: workspace.retire("alpha", " \u0007 "), "a reason is required"),
        (lambda: workspace.retire("gamma", "why"), "nothing published a concept named gamma to close"),
        (lambda: workspace.supersede("alpha", " alpha", "why"), "a concept cannot supersede itself"),
        (lambda: workspace.supersede("alpha", "gamma", "why"), "nothing published a concept named gamma to merge into"),
    ]
    for act, why in refusals:
        with pytest.raises(Refused, match=why):
            act()
    assert workspace.log().count() == before
    report = workspace.supersede("alpha", "beta", "first\nsecond", at=2).first()
    assert (report.closed, report.current, report.held) == ("alpha", 1, 2)
    with pytest.raises(Refused, match="already superseded"):
        workspace.retire("alpha", "why")
    with pytest.raises(Refused, match="a concept named alpha is already superseded"):
        workspace.supersede("beta", "alpha", "why")
    assert "(first second)" in workspace.ask("merge_losers")
    got = workspace.admit(sources(spark, "later"), said(spark, (0, "alpha", "new claim")), at=3).first()
    assert got.closed == 1
    tail = workspace.log().filter(F.col("seq") > before + 1)
    assert sorted(r.kind for r in tail.collect()) == ["assertion", "claim"]
    assert workspace.ask("search", "new claim") == "(nothing)"
    assert "claim    new claim [not current: its concept is not]" in workspace.ask("held_neighbours", "alpha")
    whole, early = workspace.history().first(), workspace.history(through=before).first()
    assert (whole.concepts, whole.held, early.concepts) == (1, 2, 2)
    assert workspace.history(as_of=1).first().through == before


def test_missing_log_is_refused(spark, tmp_path):
    with pytest.raises(record_log.LogRefused):
        Workspace(spark, str(tmp_path / "none"), create=False)


def test_text_log(spark, tmp_path):
    us, path = "\x1f", tmp_path / "publications.log"
    lines = [us.join(["concept", "asserted", "", "", f"c{n:03}"]) for n in range(50)]
    path.write_bytes(("\r\n".join(lines[:25]) + "\n\n  \n" + "\n".join(lines[25:]) + "\n").encode())
    log = record_log.import_text(spark, str(path))
    assert [r.text for r in log.orderBy("seq").collect()] == [f"c{n:03}" for n in range(50)]
    assert KnowledgeGraph.replayed(log).concepts.count() == 50
    record_log.export_text(log, str(tmp_path / "out"))
    written = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert written == lines
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(record_log.LogRefused):
        record_log.import_text(spark, str(path))


def test_positions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k")
    got = record_log.with_positions(df, ["k"]).collect()
    assert {(r.k, r.position) for r in got} == {(k, k + 1) for k in range(1000)}


def test_collisions_and_files(spark, tmp_path, rows):
    held = spark.createDataFrame([("a", b"x"), ("a", b"y"), ("b", b"z"), ("b", b"z")], "document string, content binary")
    assert rows(content_store.collisions(held)) == [("a", 2)]
    (tmp_path / "f.bin").write_bytes(b"\xff\x00")
    assert [bytes(r.content) for r in content_store.source_files(spark, str(tmp_path / "*.bin")).collect()] == [b"\xff\x00"]


def test_reports_without_readings(spark):
    statements = spark.createDataFrame([], admission.STATEMENTS)
    runs = spark.createDataFrame([(1, "d")], "run long, document string")
    got = admission.report(statements, runs).first()
    assert (got.coverage, got.concepts, got.refused) == ("unmet", 0, 0)
    blank = spark.createDataFrame([(1, "d", None, 1, 0, " ", "x")], admission.STATEMENTS)
    assert admission.report(blank).first().coverage == "barren"


def test_closings_are_judged_in_order(spark):
    held = KnowledgeGraph.folded(spark.createDataFrame([(1, "concept", "asserted", "", "", "", "a", "", "", None)], "seq long, kind string, standing string, successor string, because string, ref string, text string, source string, scope string, at long"))
    asked = spark.createDataFrame([("a", None, "r", True), ("a", None, "r", False), ("zz", None, "", True)], closing.CLOSINGS)
    got = {(r.name, r.merging): r.refusal for r in closing.verdicts(asked, held).collect()}
    assert got == {("a", True): "a successor is required", ("a", False): None, ("zz", True): "a reason is required"}
    recorded = closing.publications(closing.verdicts(asked, held), 2, 9).collect()
    assert [(r.seq, r.standing, r.because, r.at) for r in recorded] == [(2, "retired", "r", 9)]


def test_admission_through_a_reader(spark, workspace):
    """Every document is stored, every outcome reported and recorded, and nothing refused is admitted."""

    def reader(document, content, needed):
        if content == b"broken":
            raise RuntimeError("no connection")
        return [Reading("0" * 64 if content == b"astray" else document, "p", [] if content == b"barren" else [("alpha", content.decode())])]

    got = workspace.admit(sources(spark, "broken", "astray", "barren", "fine"), reader=reader, protocol="v1", name="r", at=3).orderBy("run").collect()
    assert [(r.coverage, r.refusal, r.needs) for r in got] == [
        ("unmet", "reader failed", "an answer from the reader"), ("unmet", "reader failed", "an answer from the reader"), ("barren", None, None), ("yielded", None, None),
    ]
    assert {r.admission for r in got} == {"stored"} and workspace.store.length() == 4
    assert workspace.ask("search", "fine") == "fine" and workspace.ask("search", "astray") == "(nothing)"
    kept = workspace.coverage.records().orderBy("seq").collect()
    assert [(r.seq, r.outcome, r.amount, r.protocol, r.reader, r.at) for r in kept] == [
        (1, "unmet", 0, "v1", "r", 3), (2, "unmet", 0, "v1", "r", 3), (3, "barren", 1, "v1", "r", 3), (4, "yielded", 1, "v1", "r", 3),
    ]
    facts = workspace.readings.records().collect()
    assert [(r.location, r.protocol, r.reader) for r in facts] == [("p", "v1", "r")]
    workspace.admit(sources(spark, "fine"), reader=reader, protocol="v2", name="r")
    assert workspace.coverage.last() == 5 and workspace.readings.records().select("assertion").distinct().count() == 1


def test_the_fold_is_kept_until_something_is_appended(spark, workspace):
    workspace.admit(sources(spark, "d"), said(spark, (0, "alpha", "a")), at=1)
    before = workspace.graph()
    assert workspace.graph() is before
    workspace.retire("alpha", "why")
    assert workspace.graph() is not before and workspace.graph().current().concepts().count() == 0


def test_text_log_of_several_files_and_splits(spark, tmp_path):
    """Lines of many splits and files keep their order; a torn file is named, a missing log refused."""
    us = "\x1f"
    log = spark.range(1, 3001).selectExpr("id AS seq", "'concept' AS kind", "'asserted' AS standing", "'' AS successor", "'' AS because", "'' AS ref", "concat('name ', id) AS text", "'' AS source", "'' AS scope", "CAST(NULL AS BIGINT) AS at")
    record_log.export_text(log, str(tmp_path / "out"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = record_log.import_text(spark, str(tmp_path / "out"))
        assert {(r.seq, r.text) for r in back.collect()} == {(n, f"name {n}") for n in range(1, 3001)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "out" / "part-99999.txt").write_text(us.join(["concept", "asserted", "", "", "torn"]))
    with pytest.raises(record_log.LogRefused, match="part-99999"):
        record_log.import_text(spark, str(tmp_path / "out"))
    with pytest.raises(record_log.LogRefused):
        record_log.import_text(spark, str(tmp_path / "nowhere"))


def test_what_admission_numbers_holds_no_identities(spark, workspace, monkeypatch):
    """Digests do not compress, so they are derived after the numbering, and what was numbered is dropped."""
    numbered, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (numbered.append((self, df.columns)) if name == "numbered" else None) or keep(self, df, name))
    sources = spark.createDataFrame([(1, b"one"), (2, b"one"), (3, b"two")], "run long, content binary")
    said = spark.createDataFrame(
        [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a ", "x"), (2, 0, "a", "x"), (3, 0, "b", None), (3, 1, "a", "x")],
        "run long, ordinal int, concept_name string, claim_text string",
    )
    got = {r.run: r for r in workspace.admit(sources, said, scope="s", at=7).collect()}
    assert [(got[k].coverage, got[k].refused, got[k].repeated, got[k].merged) for k in (1, 2, 3)] == [("yielded", 0, 1, 1), ("yielded", 0, 0, 0), ("yielded", 1, 0, 0)]
    assert [(got[1][f"corpus_{c}"]) for c in ("concepts", "claims", "citations")] == [2, 2, 3]
    assert not any({"id", "ref", "assertion"} & set(columns) for _, columns in numbered)
    assert not any(os.path.exists(s.path("numbered").removeprefix("file://")) for s, columns in numbered if "claim_text" in columns)
    log = workspace.log().orderBy("seq").collect()
    assert [r.seq for r in log] == list(range(1, len(log) + 1))
    assert [(r.kind, r.text) for r in log] == [
        ("concept", "a"), ("concept", "b"), ("claim", "x"), ("claim", "y"), ("assertion", ""), ("assertion", ""),
        ("concept", "a"), ("claim", "x"), ("assertion", ""), ("concept", "a"), ("claim", "x"), ("assertion", ""),
    ]
    facts = workspace.readings.records().orderBy("seq").collect()
    assert [r.seq for r in facts] == [1, 2, 3] and len({r.assertion for r in facts}) == 3
    held = {r.assertion for r in workspace.graph().assertions.select("assertion").collect()}
    assert {r.assertion for r in facts} == held
