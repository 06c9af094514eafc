import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stelae.llm import quantiles
from stelae.llm.quantiles import Compactors, merged, once_each, percentiles, sketched

PS = {"p50": 0.5, "p99": 0.99}


def off(values, answer, p):
    """Ranks between the answer and the asked rank."""
    ordered = np.sort(values)
    low, high = np.searchsorted(ordered, answer, "left") + 1, np.searchsorted(ordered, answer, "right")
    want = max(1, math.ceil(p * len(values) - 1e-9))
    return max(0, low - want, want - high)


@pytest.mark.parametrize("shape", ["uniform", "ties", "sorted", "extreme", "few"])
def test_error_stays_in_its_bound(shape):
    rng = np.random.default_rng(3)
    n = {"few": 400}.get(shape, 300_000)
    values = {
        "uniform": rng.integers(0, 10**9, n), "ties": rng.integers(0, 5, n), "sorted": np.arange(n),
        "extreme": rng.choice([-(2**63), 0, 2**63 - 1], n), "few": rng.integers(0, 10**6, n),
    }[shape].astype(np.int64)
    sketch = Compactors()
    for part in np.array_split(values, 7):
        sketch.update(part)
    assert sketch.n == n and (sketch.low, sketch.high) == (values.min(), values.max())
    assert sum(map(len, sketch.levels)) < 3 * 512 + 100
    bound = sketch.rank_error() * n
    assert bound / n < 0.02 and (shape != "few" or bound == 0)
    for p in (0.001, 0.1, 0.5, 0.9, 0.99, 1.0, 0.0):
        assert off(values, sketch.percentiles([p])[0], max(p, 1 / n)) <= bound + 1


def test_bound_holds_for_large_n():
    """The bound over n does not grow with n."""
    rng = np.random.default_rng(1)
    sketch, bounds = Compactors(), []
    for _ in range(30):
        sketch.update(rng.integers(0, 2**40, 100_000))
        bounds.append(sketch.rank_error())
    assert max(bounds) < 0.02


def test_merge_equals_one_sketch_within_the_bound():
    rng = np.random.default_rng(7)
    parts = [rng.normal(size=rng.integers(1, 20_000)) * 1e6 for _ in range(60)]
    whole = np.concatenate(parts).astype(np.int64)
    total = Compactors()
    for part in parts:
        one = Compactors()
        one.update(part.astype(np.int64))
        total.merge(Compactors.of_row(one.k, *one.row()))
    assert total.n == len(whole)
    for p in (0.01, 0.25, 0.5, 0.75, 0.99):
        assert off(whole, total.percentiles([p])[0], p) <= total.rank_error() * total.n + 1
    before = total.row()
    total.merge(Compactors())
    assert total.row() == before


def test_equal_partitions_toss_their_own_coins():
    """A thousand copies of one partition: their errors do not add up, and a repeat gives the same."""
    rng = np.random.default_rng(11)
    part = rng.integers(0, 10**9, 4_000).astype(np.int64)

    def whole(times):
        total = Compactors(name=("merge",))
        for n in range(times):
            one = Compactors(name=("build", n))
            one.update(part)
            total.merge(Compactors.of_row(one.k, *one.row()))
        return total

    total = whole(1_000)
    values = np.tile(part, 1_000)
    for p in (0.01, 0.25, 0.5, 0.75, 0.99):
        assert off(values, total.percentiles([p])[0], p) <= total.rank_error() * total.n + 1
    assert whole(40).row() == whole(40).row()
    first, second = Compactors(name=("build", 1)), Compactors(name=("build", 2))
    first.update(part), second.update(part)
    assert first.row() != second.row()


def test_sketches_are_merged_in_steps(spark, monkeypatch):
    """No task of the last step sees more sketches of a group than there are groups of tasks."""
    monkeypatch.setattr(quantiles, "FAN_IN", 4)
    df = spark.range(0, 64_000, 1, 16).selectExpr("'hot' AS model", "id AS w")
    sketches = sketched(df, ["model"], ["w"])
    assert sketches.count() == 1
    answer = percentiles(sketches, ["model"], PS).first()
    assert answer.n == 64_000 and abs(answer.p50 - 32_000) <= answer.rank_error * 64_000 + 1
    near = quantiles._merge_step(sketches.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["model"], F.floor(F.col("part") / 4), quantiles.K, 0, 1)
    assert sorted(r.part for r in near.collect()) == [0, 1, 2, 3]


def test_groups_days_and_the_whole(spark):
    rng = np.random.default_rng(2)
    data = [(m, d, None if rng.random() < 0.1 else int(rng.integers(0, 100)), int(rng.integers(0, 10**12))) for m in ("a", None) for d in range(3) for _ in range(700)]
    data += [("only nulls", 1, None, None)]
    df = spark.createDataFrame(data, "model string, day int, w long, c long").repartition(5)
    daily = sketched(df.withColumn("n", F.lit("other column")), ["model", "day"], ["w", "c"])
    got = {(r.model, r.day, r.metric): r for r in percentiles(daily, ["model", "day"], PS).collect()}
    whole = {(r.model, r.metric): r for r in percentiles(merged(daily, ["model"]), ["model"], PS).collect()}
    assert len(got) == 12 and len(whole) == 4
    for (model, day, metric), r in got.items():
        values = np.array([x for m, d, *v in data if (m, d) == (model, day) for x in [v[metric == "c"]] if x is not None])
        assert (r.n, r.low, r.high) == (len(values), values.min(), values.max())
        assert all(off(values, r[p], PS[p]) <= r.rank_error * r.n + 1 for p in PS)
    for (model, metric), r in whole.items():
        values = np.array([x for m, d, *v in data if m == model for x in [v[metric == "c"]] if x is not None])
        assert (r.n, r.low, r.high) == (len(values), values.min(), values.max())
        assert all(off(values, r[p], PS[p]) <= r.rank_error * r.n + 1 for p in PS)


def test_repeats_are_counted_once_and_empty_tables_pass(spark, rows):
    schema = "call_id long, model string, v long, loaded long"
    df = spark.createDataFrame([(1, "a", 5, 2), (1, "a", 5, 1), (2, "a", None, None), (None, "b", 1, 1), (None, "b", 1, 1)], schema)
    assert rows(once_each(df, "call_id", ["model", "v"], "loaded")) == [("a", 5), ("a", None), ("b", 1), ("b", 1)]
    empty = spark.createDataFrame([], schema)
    assert percentiles(sketched(empty, ["model"], ["v"]), ["model"], PS).count() == 0
