import itertools
import random

import numpy as np

from stelae.llm import mixing


def test_subset_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 5))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 80)
        taken = mixing.subset_fill(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        got = sum(t * n for t, n in zip(taken, lengths))
        sums = [sum(t * n for t, n in zip(c, lengths)) for c in itertools.product(*(range(c + 1) for c in counts))]
        assert got == max(s for s in sums if s <= budget)


def test_subset_fill_without_a_way_to_the_budget():
    """All lengths even and an odd budget: every bundle is looked at, and the table stays one entry per sum."""
    taken = mixing.subset_fill(list(range(2, 402, 2)), [1_000] * 200, 9_999)
    assert sum(t * n for t, n in zip(taken, range(2, 402, 2))) == 9_998


def test_plan_keeps_budget_counts_and_lengths():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.choice(np.arange(1, 5000), 400, replace=False))
    counts = rng.integers(1, 40, 400)
    tokens = int((lengths * counts).sum())
    for share in (0.0, 0.01, 0.37, 0.999, 1.0, 1.5, 3.0):
        budget = int(tokens * share)
        repeats, more = mixing.plan_source(lengths, counts, budget, 1)
        assert ((more >= 0) & (more <= counts)).all()
        taken = repeats * tokens + int((more * lengths).sum())
        assert budget - 2 <= taken <= budget
    _, half = mixing.plan_source(lengths, counts, tokens // 2, 1)
    assert abs((half * lengths).sum() / half.sum() - (counts * lengths).sum() / counts.sum()) < 100
    assert mixing.plan_source(lengths, counts, 0, 1)[1].sum() == 0


DOCS = "doc_id long, source string, tokens long, copies int, held int"
TARGETS = "source string, target_share double, max_repeats int, tokens long"


def documents(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice(["a", "a", "a", "b", None, "untargeted"]), rng.randrange(0, 300), 7, 7) for n in range(1200)]
    rows += [(5000 + n, "small", 50, 0, 0) for n in range(12)] + [(6000, "b", None, 0, 0), (None, "a", 40, 0, 0)]
    return spark.createDataFrame(rows, DOCS), rows


def test_shares_caps_and_report(spark):
    docs, rows = documents(spark)
    targets = spark.createDataFrame([("a", 0.6, 1, 0), ("b", 0.3, 2, 0), ("small", 0.1, 3, 0), ("absent", 0.0, 5, 0)], TARGETS)
    selection, report = mixing.mixed(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "small", "absent"} and got["absent"].tokens_taken == 0
    for r in got.values():
        assert abs(r.off_target) < 0.005 and r.most_copies <= r.max_repeats
    assert got["small"].most_copies == 3 and got["small"].tokens_taken == 12 * 50 * 3
    chosen = selection.collect()
    assert {r.source for r in chosen} == {"a", "b", "small"} and all(r.copies > 0 and r.tokens > 0 for r in chosen)
    assert len({r.doc_id for r in chosen}) == len(chosen)
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    again = mixing.mixed(docs, targets)[0]
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, chosen), key=repr)
    other = mixing.mixed(docs, targets, seed=7)[0]
    assert sorted(map(tuple, other.collect()), key=repr) != sorted(map(tuple, chosen), key=repr)


def test_given_total_and_hot_length_class(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 37)  # many ranges of one class
    docs = spark.range(1000).selectExpr("id AS doc_id", "'one' AS source", "cast(if(id < 900, 10, 3) as long) AS tokens")
    targets = spark.createDataFrame([("one", 1.0, 2, 0)], TARGETS)
    for total in (0, 5, 1234, 9300, 12_345, 99_999):
        selection, report = mixing.mixed(docs, targets, total_tokens=total)
        taken = sum(r.tokens * r.copies for r in selection.collect())
        assert taken == report.first().tokens_taken and min(total, 18_600) - 2 <= taken <= min(total, 18_600)


def test_odd_targets_and_empty_tables(spark):
    docs, _ = documents(spark)
    odd = spark.createDataFrame([("a", None, 1, 0), (None, 0.5, 1, 0), ("b", 0.5, None, 0), ("small", 0.25, 0, 0), ("b", 0.25, 9, 0)], TARGETS)
    got = {r.source: r for r in mixing.mixed(docs, odd)[1].collect()}
    assert got["a"].tokens_taken == got["small"].tokens_taken == 0 and got["b"].most_copies == 1 and got["b"].target_share == 0.75
    selection, report = mixing.mixed(docs.limit(0), odd)
    assert selection.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    assert mixing.mixed(docs, odd.limit(0))[1].count() == 0
