import random

import numpy as np
import pytest

from stelae.operators import admission, audit, closing, relations
from stelae.operators.graph import LOG, KnowledgeGraph, violations
from stelae.operators.ranked import nearest
from stelae.operators.relations import closure, kernel_faults
from stelae.operators.workspace import Refused, Workspace

EDGES = "kind string, source string, target string, step int"


def test_closure_of_certified_kinds_only(spark, rows):
    rng = random.Random(3)
    edges = {("t", f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(30)} | {("t", f"c{i}", f"c{i + 1}") for i in range(20)}
    other = {("u", "a", "b"), ("u", "b", "c")}
    df = spark.createDataFrame([(*e, 0) for e in edges | other] + [("t", None, "x", 0), ("t", "", "x", 0)], EDGES)
    reach = set(edges)
    while True:
        more = {("t", a, d) for _, a, b in reach for _, c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    assert rows(closure(df, ["t"])) == sorted(reach | other, key=repr)
    assert rows(closure(df.limit(0), ["t"])) == []


def test_kernel_faults(spark, rows):
    sound = [("thing", None, 0), ("idea", "thing", 1), ("claim", "idea", 2)]
    df = lambda data: spark.createDataFrame(data, "type string, parent string, layer int")
    assert rows(kernel_faults(df(sound))) == rows(kernel_faults(df(sound).limit(0))) == []
    bad = [*sound, ("zoo", "", 0), ("x", "y", 1), ("y", "x", 1), ("lost", "nowhere", 1), ("idea", "thing", 3)]
    assert rows(kernel_faults(df(bad))) == [
        ("idea", "several layers"), ("lost", "an unknown parent"), ("x", "in a cycle"), ("y", "in a cycle"), ("zoo", "a second root"),
    ]


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = vectors[5]  # a tie
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(100, None), (101, [0.0] * 8), (102, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(df, df.filter("vec_id % 10 = 0"), 5, block=block).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:5]
        assert got[q] == want
    assert set(got) == set(range(0, 60, 10))
    assert nearest(df, df.limit(0), 5).count() == 0


def test_reopening(spark, tmp_path):
    said = spark.createDataFrame([(0, 0, "alpha", "a"), (0, 1, "beta", "b")], "run long, ordinal int, concept_name string, claim_text string")
    sources = spark.createDataFrame([(0, b"d")], "run long, content binary")
    work = Workspace(spark, None, reopening=True)
    work.admit(sources, said)
    work.supersede("alpha", "beta", "why")
    for name, because, refusal in (("beta", "x", "is current"), ("gamma", "x", "nothing published"), ("alpha", " ", "a reason is required")):
        with pytest.raises(Refused, match=refusal):
            work.reopen(name, because)
    assert work.reopen("alpha", "it was right").first().current == 2
    assert work.ask("search", "a") == "a"
    with pytest.raises(Refused, match="does not reopen"):
        Workspace(spark, None).reopen("alpha", "x")
    log = spark.createDataFrame([(1, "concept", "reopened", "", "why", "", "a", "", "", None)], LOG)
    assert violations(log).count() == 1 and violations(log, reopening=True).count() == 0
    held = KnowledgeGraph.folded(log)
    assert closing.reopenings(spark.createDataFrame([("a", "x")], "name string, because string"), held).first().refusal == "a concept named a is current"


def test_failed_run_and_promotion(spark, rows):
    documents = spark.createDataFrame([("d",), ("e",)], "document string")
    read = spark.createDataFrame([("d",)], "document string")
    assert rows(audit.failed_run(documents, read)) == [("e", "unmet", "an answer from the reader")]
    broad = spark.createDataFrame([(1, "0" * 64, "broad")], "promotion int, concept string, text string")
    narrow = spark.createDataFrame([(1, "n1"), (1, "n2"), (2, "n3")], "promotion int, assertion string")
    derived = admission.promoted(broad, narrow)
    now = spark.createDataFrame([("n1", "n1")], "input string, identity_now string")
    assert [r.status for r in audit.stale(derived, now).collect()] == ["unsupported"] and derived.count() == 2


def test_nearest_of_queries_of_several_lengths(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.2, 0.0]), (5, []), (6, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for block in (1, 4_096):
        got = {(r.query, r.neighbour) for r in nearest(df, df, 3, block=block).collect()}
        assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_algebra_of_declared_relations(spark, rows):
    def relation(name, kind, *given):
        return (name, kind, *(p in given for p in relations.PROPERTIES))

    declared = spark.createDataFrame(
        [relation("same as", "identity", "reflexive", "symmetric", "transitive"), relation("like", "identity", "reflexive", "symmetric"),
         relation("odd", "friendship"), relation("part of", "compositional", "transitive"), relation("near", "analogy", "transitive"), ("void", "analogy", *[None] * 12)],
        relations.RELATIONS,
    )
    demands = spark.createDataFrame([*relations.IDENTITY_DEMANDS, ("analogy", "transitive", False)], relations.DEMANDS)
    assert rows(relations.algebra_faults(declared, demands)) == [
        ("like", "transitive", "required"), ("near", "transitive", "forbidden"), ("odd", None, "of no known kind"), ("part of", None, "of a kind that demands nothing"),
    ]
    assert rows(relations.certified(declared, demands)) == [("same as",)]
    assert len(relations.KINDS) == len(set(relations.KINDS)) == 21 and len(relations.PROPERTIES) == 12
