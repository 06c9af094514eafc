"""Mixing sources to target shares of the total size.

1. Documents are counted per source and exact token length.  A source with T
   tokens has at most sqrt(2 T) distinct lengths, so this table stays small: the
   plan of one source fits a task whatever the corpus.
2. The total is the largest one for which every source that has tokens can give
   its share with no document taken more than ``max_repeats`` times, or the given
   ``total_tokens``.  A source's budget is its share of the total, but no more
   than it can give.
3. Whole repeats of a source are taken first.  Of the rest of the budget every
   length class gives the same fraction, rounded down, so that the choice keeps
   the lengths' distribution.  What is then left of the budget is filled exactly,
   or as nearly as it can be, by bounded-knapsack dynamic programming over the
   remaining counts of the lengths.
4. Documents are selected by those counts: within a length class in the order of
   a seeded hash.  Large classes are cut into hash ranges that are counted first,
   so that only one range of a class is ever ordered and no task sees a class
   with a third of all rows whole.

Cases: documents of null source, of a source without target, and of no tokens
are not taken; a target of null or non-positive share takes nothing; null
``max_repeats`` is 1, less than 1 takes nothing; several targets of one source
add up their shares under the least ``max_repeats``; a target without documents
gets nothing and is reported, the others keep their shares of the total and so
exceed them in proportion; repeated document rows are documents of their own;
equal hashes are ordered by document; empty tables report 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 50_000


def subset_fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length make up the largest total of at most ``budget``.

    Bounded knapsack over sums: each length is taken in bundles of 1, 2, 4, ...,
    the reachable sums are the bits of one integer, and of every sum the bundle that
    reached it first is kept, so the table has one entry per sum however many bundles
    there are.  It ends as soon as the budget itself is reached.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    mask = (1 << (budget + 1)) - 1
    reach, bundles, first = 1, [], np.full(budget + 1, -1, np.int64)
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, bundle = min(count, budget // length if length else 0), 1
        while left > 0 and not reach >> budget & 1:
            some = min(bundle, left)
            fresh = (reach << (some * length)) & mask & ~reach
            sums = np.frombuffer(fresh.to_bytes(budget // 8 + 1, "little"), np.uint8)
            first[np.flatnonzero(np.unpackbits(sums, bitorder="little")[: budget + 1])] = len(bundles)
            bundles.append((i, some))
            reach |= fresh
            left, bundle = left - some, bundle * 2
        if reach >> budget & 1:
            break
    total = reach.bit_length() - 1
    while total:  # a sum was first reached from one that an earlier bundle had reached
        i, some = bundles[first[total]]
        taken[i] += some
        total -= some * lengths[i]
    return taken


def plan_source(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> tuple[int, np.ndarray]:
    """Whole repeats of the source, and how many documents of each length get one
    copy more, so that the tokens come nearest to ``budget`` from below."""
    tokens = int((lengths * counts).sum())
    if tokens <= 0 or budget <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    repeats, rest = divmod(int(budget), tokens)
    rng = np.random.default_rng(seed)
    even = counts * (rest / tokens)
    more = np.floor(even).astype(np.int64)
    rest -= int((more * lengths).sum())
    # Rounding down left up to one document per length: those are drawn with the
    # fraction as their chance, then in any order, until the sums are small.
    small = 8 * int(np.median(lengths)) + 4096
    order = rng.permutation(len(lengths))
    drawn = rng.random(len(lengths)) < even - np.floor(even)
    for i in [*order[drawn[order]], *order[~drawn[order]]]:
        if rest <= small:
            break
        if more[i] < counts[i] and lengths[i] <= rest:
            more[i] += 1
            rest -= int(lengths[i])
    free = counts - more
    fill = subset_fill([int(lengths[i]) for i in order], [int(free[i]) for i in order], rest)
    for i, some in zip(order, fill):
        more[i] += some
    return repeats, more


def _targets(targets: DataFrame) -> DataFrame:
    return (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("target_share"),
            F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"),
        )
    )


def _plan(budgets: dict[str, int], seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # In order of length: the plan must not depend on how the rows arrived.
        frame = pd.concat(list(frames)).sort_values("tokens", ignore_index=True)
        source = frame["source"].iloc[0]
        repeats, more = plan_source(
            frame["tokens"].to_numpy(np.int64), frame["held"].to_numpy(np.int64), budgets[source], seed
        )
        yield frame.assign(repeats=repeats, more=more)

    return lambda frame: next(run(iter([frame])))


def mixed(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    total_tokens: int | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The selection ``key, source, tokens, copies`` and the report per target.

    ``documents`` has ``key``, ``source`` and ``tokens``; ``targets`` has
    ``source``, ``target_share`` and ``max_repeats``, one row per source, and is
    small by its nature: it is what a person asked for.
    """
    wanted = _targets(targets)
    usable = documents.filter((F.col("tokens") > 0) & F.col("source").isNotNull())
    classes = usable.join(wanted.select("source"), "source", "left_semi").groupBy("source", "tokens").agg(
        F.count("*").alias("held")
    )
    supply = (
        classes.groupBy("source").agg(F.sum("held").alias("documents"), F.sum(F.col("held") * F.col("tokens")).alias("tokens"))
    )
    held = wanted.join(supply, "source", "left").na.fill(0, ["documents", "tokens"]).collect()
    able = [r for r in held if r.target_share > 0 and r.tokens and r.max_repeats]
    if total_tokens is None:
        total_tokens = min((math.floor(r.max_repeats * r.tokens / r.target_share) for r in able), default=0)
    budgets = {r.source: 0 for r in held}
    budgets |= {r.source: min(math.floor(r.target_share * total_tokens + 0.5), r.max_repeats * r.tokens) for r in able}

    planned = classes.groupBy("source").applyInPandas(
        _plan(budgets, seed), "source string, tokens long, held long, repeats long, more long"
    )
    hashed = usable.select(
        key, "source", "tokens", F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_hash")
    ).join(planned, ["source", "tokens"])
    ranges = F.greatest(F.lit(1), F.ceil(F.col("held") / RANGE_ROWS))
    width = F.floor(F.lit(2.0**64) / ranges)
    ranged = hashed.withColumn(
        "_range", F.when(ranges == 1, F.lit(0)).otherwise(F.floor((F.col("_hash") + F.lit(2.0**63)) / width)).cast("long")
    )
    counted = ranged.groupBy("source", "tokens", "_range").agg(F.count("*").alias("_in"))
    before = F.sum("_in").over(
        Window.partitionBy("source", "tokens").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counted.select("source", "tokens", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "_range").orderBy("_hash", key))
    selection = (
        ranged.withColumn("_rank", rank)
        .join(offsets, ["source", "tokens", "_range"])
        .withColumn(
            "copies", (F.col("repeats") + (F.col("_before") + F.col("_rank") <= F.col("more")).cast("long")).cast("int")
        )
        .filter(F.col("copies") > 0)
        .select(key, "source", "tokens", "copies")
    )
    return selection, _report(documents.sparkSession, held, budgets, selection)


def _report(spark, held, budgets, selection: DataFrame) -> DataFrame:
    rows = [
        (r.source, float(r.target_share), int(r.max_repeats), int(r.documents), int(r.tokens), int(budgets[r.source]))
        for r in held
    ]
    asked = spark.createDataFrame(
        rows,
        "source string, target_share double, max_repeats int, documents_held long, tokens_held long, budget long",
    )
    got = selection.groupBy("source").agg(
        F.count("*").alias("documents_taken"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_taken"),
    )
    taken = ["documents_taken", "copies", "most_copies", "tokens_taken"]
    joined = asked.join(got, "source", "left").na.fill(0, taken)
    total = F.sum("tokens_taken").over(Window.partitionBy())
    return joined.withColumn(
        "actual_share", F.when(total > 0, F.col("tokens_taken") / total).otherwise(F.lit(0.0))
    ).withColumn("off_target", F.col("actual_share") - F.col("target_share"))
