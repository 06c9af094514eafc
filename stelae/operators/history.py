"""Time travel: the graph of a prefix of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stelae.functions.keys import packed
from stelae.operators.graph import ARITY, identified, is_current, violations

COUNTS = ("concepts", "claims", "citations", "held")
# Fixed value: how a question that the log cannot answer is refused.
UNTIMED = "nothing in this log carries a time, so as of {} cannot be answered"


class HistoryRefused(ValueError):
    """A prefix that the log does not have."""


def through(log: DataFrame, count: int) -> DataFrame:
    """The first ``count`` publications of a log numbered from 1 without gaps.

    More than the log holds is refused, not clamped.
    """
    if count < 0:
        raise HistoryRefused("a count cannot be negative")
    held = log.agg(F.max("seq")).first()[0] or 0
    if count > held:
        raise HistoryRefused(f"{count} publications were asked for and the log holds {held}")
    return log.filter(F.col("seq") <= count)


def as_of(log: DataFrame, seconds: int) -> DataFrame:
    """The publications before the first one that is later than ``seconds``.

    A prefix and no filter: what follows a later record is left out whatever its
    time, and untimed records pass.  A log without any time is refused.
    """
    bounds = log.agg(
        F.count("at").alias("timed"), F.min(F.when(F.col("at") > seconds, F.col("seq"))).alias("cut")
    ).first()
    if not bounds.timed:
        raise HistoryRefused(UNTIMED.format(seconds))
    return log if bounds.cut is None else log.filter(F.col("seq") < bounds.cut)


def counts(prefix: DataFrame) -> DataFrame:
    """Current concepts, claims and citations and held concepts of a prefix, one row.

    Counted over packed identities: of the fold of a log nothing else is needed.
    """
    rows = identified(prefix).filter(F.col("id").isNotNull()).select("kind", packed(F.col("id")).alias("id"), packed(F.col("ref")).alias("ref"), "standing", "seq")

    def last(kind: str, *columns: str) -> DataFrame:
        order = Window.partitionBy("id").orderBy(F.col("seq").desc())
        ranked = rows.filter(F.col("kind") == kind).select("id", "seq", "standing", *columns).withColumn("_rank", F.row_number().over(order))
        return ranked.filter(F.col("_rank") == 1).select("id", is_current(F.col("standing")).alias("live"), *columns)

    concepts = last("concept")
    alive = concepts.filter("live").select(F.col("id").alias("ref"))
    claims = last("claim", "ref").filter("live").join(alive, "ref", "left_semi")
    held = last("assertion", "ref").filter("live").join(claims.select(F.col("id").alias("ref")), "ref", "left_semi")
    parts = [alive.select(F.lit("concepts").alias("what")), claims.select(F.lit("claims").alias("what")), held.select(F.lit("citations").alias("what")), concepts.select(F.lit("held").alias("what"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(*(F.count(F.when(F.col("what") == n, 1)).alias(n) for n in COUNTS))


def replay(log: DataFrame, reopening: bool = False) -> DataFrame:
    """One row for a whole log: its first bad record (``refused_at``, ``error``), or null there
    and the counts of its graph.

    The records are grouped by identity once: the group's first position is what its
    children must come after, its last version is what is held.
    """
    rows = identified(log)
    state = rows.filter(F.col("id").isNotNull() & F.col("kind").isin(*ARITY)).groupBy("kind", "id").agg(
        F.max_by(F.struct("ref", "standing"), "seq").alias("last")
    )
    live = state.filter(is_current(F.col("last.standing")))
    alive = lambda kind: live.filter(F.col("kind") == kind)
    concepts = alive("concept").select(F.col("id").alias("concept"))
    claims = alive("claim").select(F.col("id").alias("claim"), F.col("last.ref").alias("concept")).join(concepts, "concept", "left_semi")
    cited = alive("assertion").select(F.col("last.ref").alias("claim")).join(claims.select("claim"), "claim", "left_semi")
    one = lambda frame, what: frame.select(F.lit(what).alias("what"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("error"))
    bad = violations(rows, reopening).select(F.lit("bad").alias("what"), "seq", "error")
    parts = one(concepts, "concepts").unionByName(one(claims, "claims")).unionByName(one(cited, "citations"))
    parts = parts.unionByName(one(state.filter("kind = 'concept'"), "held")).unionByName(bad)
    first = F.min(F.when(F.col("what") == "bad", F.struct("seq", "error"))).alias("_first")
    counted = parts.agg(*(F.count(F.when(F.col("what") == n, 1)).alias(n) for n in COUNTS), first)
    good = F.col("_first").isNull()
    return counted.select(
        *(F.when(good, F.col(n)).alias(n) for n in COUNTS), F.col("_first.seq").alias("refused_at"), F.col("_first.error").alias("error")
    )


def timeline(log: DataFrame) -> DataFrame:
    """``month, publications, concepts_held``: the log's growth by UTC month, where a
    record counts from the first moment at which an as-of question would reach it.

    Records are as old as the latest time before them in the log, which needs one
    running maximum; it is taken over blocks of 65,536 positions first, so that
    no window holds the log.
    """
    from pyspark.sql import Window

    from stelae.functions.keys import utc_month

    blocked = log.withColumn("_block", F.shiftright("seq", 16))
    tops = blocked.groupBy("_block").agg(F.max("at").alias("_top"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_block", F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    aged = (
        blocked.withColumn("_inside", F.max("at").over(inside))
        .join(carried, "_block")
        .withColumn("_age", F.greatest("_inside", "_before"))
    )
    return aged.groupBy(utc_month(F.col("_age")).alias("month")).agg(
        F.count("*").alias("publications"), F.count(F.when(F.col("kind") == "concept", 1)).alias("concept_records")
    )
