import random

from stelae.operators.change_feed import deduplicated, latest_changes, merged, present, unrecognised

SCHEMA = "kind string, id string, op string, at long, seq long, standing string, deleted string, extra string"
OPS = ["i", "INSERT", "c", "Create", "u", "UPDATE", "d", "Delete", " delete "]


def changes(rng, n, subjects):
    out = []
    for seq in range(n):
        op = rng.choice(OPS)
        at = rng.choice([None, *range(6)])
        row = ("k", f"s{rng.randrange(subjects)}", op, at, seq, rng.choice(["a", "b", None]), "x", None)
        out += [row] * rng.choice([1, 1, 2])
    rng.shuffle(out)
    return out


def replayed(rows):
    held = {}
    for kind, key, op, at, seq, standing, *_ in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[4])):
        held[kind, key] = None if op.strip().lower()[0] == "d" else (standing,)
    return sorted(((*k, *v) for k, v in held.items() if v is not None), key=repr)


def applied(df, base=None):
    return latest_changes(df, ["kind", "id"], ["at", "seq"], ["standing"], base=base)


def test_any_order_and_repeats(spark, rows):
    for seed in range(4):
        given = changes(random.Random(seed), 120, 9)
        assert rows(present(applied(spark.createDataFrame(given, SCHEMA)), ["at", "seq"])) == replayed(given)


def test_batches_in_any_order_equal_one_batch(spark, rows):
    given = changes(random.Random(9), 90, 7)
    whole = applied(spark.createDataFrame(given, SCHEMA))
    late = applied(spark.createDataFrame(given[50:], SCHEMA))
    both = applied(spark.createDataFrame(given[:50], SCHEMA), late)
    assert rows(both) == rows(whole)


def test_odd_rows(spark, rows):
    given = [
        (None, None, "i", None, None, None, None, None), ("k", "a", None, 1, 1, "x", None, None), ("k", "a", "cancel", 2, 2, "x", None, None),
        ("k", "b", "u", 1, 1, "late insert missing", None, None), ("k", "c", "i", 5, 1, "x", None, None), ("k", "c", "d", 5, 1, None, None, None),
    ]
    df = spark.createDataFrame(given, SCHEMA)
    assert rows(unrecognised(df).select("op")) == [("cancel",), (None,)]
    # Of equal orders the kept row does not depend on arrival: here the one that leaves the subject present.
    assert rows(present(applied(df), ["at", "seq"])) == [("k", "b", "late insert missing"), ("k", "c", "x"), (None, None, None)]
    assert rows(applied(spark.createDataFrame([], SCHEMA))) == []


def test_hot_subject_is_limited_before_its_exchange(spark):
    df = spark.range(1000).selectExpr("cast(id div 5000 as string) kind", "cast(id div 1000 as string) id", "'u' op", "id at", "id seq", "cast(id as string) standing")
    latest = applied(df)
    assert [r.standing for r in latest.collect()] == ["999"]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_an_identifier_is_applied_once(spark, rows):
    """A change that comes again with other contents is settled before changes are ranked."""
    given = [("k", "a", "i", 1, 7, "x", None, None), ("k", "a", "u", 9, 7, "y", None, None), ("k", "a", "d", 5, 8, None, None, None), (None, "b", "i", 1, None, "z", None, None)]
    df = spark.createDataFrame(given, SCHEMA)
    once = deduplicated(df, ["kind", "id"], ["seq"], ["at", "seq"], ["standing"])
    assert rows(once.select("id", "at", "deleted")) == [("a", 5, True), ("a", 9, False), ("b", 1, False)]
    latest = latest_changes(df, ["kind", "id"], ["at", "seq"], ["standing"], identity=["seq"])
    assert rows(latest.select("id", "standing")) == [("a", "y"), ("b", "z")]


def test_merge_keeps_the_newer_row_and_null_subjects(spark, rows):
    schema = "kind string, id string, at long, seq long, standing string, deleted boolean"
    base = spark.createDataFrame([("k", "a", 5, 1, "old", False), (None, None, None, 1, "n", False), ("k", "gone", 9, 9, None, True), ("k", "only", 1, 1, "b", False)], schema)
    late = spark.createDataFrame([("k", "a", 4, 9, "late", False), (None, None, 0, 0, "m", False), ("k", "gone", 8, 9, "back", False), ("k", "new", None, 1, "c", False)], schema)
    got = merged(base, late, ["kind", "id"], ["at", "seq"], ["standing"])
    assert rows(present(got, ["at", "seq"])) == sorted([("k", "a", "old"), (None, None, "m"), ("k", "only", "b"), ("k", "new", "c")], key=repr)
    assert rows(merged(base.limit(0), late, ["kind", "id"], ["at", "seq"], ["standing"])) == rows(late.select("kind", "id", "at", "seq", "standing", "deleted"))
    assert rows(merged(base, late.limit(0), ["kind", "id"], ["at", "seq"], ["standing"])) == rows(base)
