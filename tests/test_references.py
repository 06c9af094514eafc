import random

from stelae.operators.references import Parent, Reference, orphan_counts, orphans

PARENT = "key string, removed long, at long, period string"
CHILD = "child string, ref string, at long, key string, held int"


def brute(parents, children):
    out = set()
    for child, ref, at, *_ in children:
        if not ref:
            continue
        mine = [p for p in parents if p[0] == ref]
        if not mine:
            reason = "missing"
        elif all(p[1] is not None for p in mine):
            reason = "deleted"
        elif at is not None and all(p[2] is not None for p in mine) and at < min(p[2] for p in mine):
            reason = "later"
        else:
            continue
        out.add(("c", child, "untimed" if at is None else "1970-01", reason))
    return sorted(out, key=repr)


def found(spark, parents, children):
    p = Parent("p", spark.createDataFrame(parents, PARENT), "key", "removed", "at")
    c = Reference("c", spark.createDataFrame(children, CHILD), "child", "ref", "p", "at")
    return orphans([p], [c])


def test_against_brute_force(spark, rows):
    rng = random.Random(5)
    keys = ["a", "A", "a ", "a\n", "", None, "f" * 64, "f" * 64 + "\n"]
    for _ in range(3):
        parents = [(rng.choice(keys), rng.choice([None, 3]), rng.choice([None, *range(5)]), "x") for _ in range(6)]
        children = [(rng.choice(["x", "y", "z", None]), rng.choice(keys), rng.choice([None, *range(5)]), "k", 1) for _ in range(40)]
        children += children[:5]
        assert rows(found(spark, parents, children)) == brute(parents, children)


def test_empty_tables_and_counts(spark, rows):
    child = [("x", "a", 0, None, None), ("x", "a", 0, None, None), ("y", "a", None, None, None)]
    assert rows(found(spark, [], child)) == [("c", "x", "1970-01", "missing"), ("c", "y", "untimed", "missing")]
    assert rows(found(spark, [("a", None, 1, "")], [])) == []
    assert rows(orphan_counts(found(spark, [], child))) == [("c", "1970-01", "missing", 1), ("c", "untimed", "missing", 1)]


def test_hot_key_is_combined_before_its_exchange(spark):
    children = spark.range(5000).selectExpr("cast(id as string) child", "'hot' ref", "id at")
    parents = spark.createDataFrame([("hot", 7, 0)], "key string, removed long, at long")
    got = orphans([Parent("p", parents, "key", "removed", "at")], [Reference("c", children, "child", "ref", "p", "at")])
    assert got.count() == 5000 and {r.reason for r in got.select("reason").distinct().collect()} == {"deleted"}
