"""References to records that do not exist.

Parent keys and child references are united in one long table, tagged by the
parent table, and grouped by parent table and key.  A group without a parent row
is *missing*, one whose parent rows are all removed *deleted*, and one whose
first parent row is younger than one of its references is *later*.  Grouping
carries flags and extremes only, so it is combined on the map side and a key
with a third of all references costs each task one row.  Only groups with a
finding are joined back to the references; that side is broadcast when it is
measured to be small, else both sides are sorted and a hot key is split by
adaptive execution.

Cases: a null or empty reference is none; keys match octet for octet; a parent
row with a null or empty key is no parent; an untimed parent row precedes
everything; an untimed reference is never *later*; repeated rows give one
finding; a null child key is kept as null; empty tables give no finding, or
*missing* for every reference if the parent table is the empty one; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelae.functions.keys import packed, stated, unpacked, utc_month

_BEFORE_ALL = -(2**63)


@dataclass(frozen=True)
class Parent:
    """A table that is referred to.  ``removed`` is null in an open row."""

    name: str
    rows: DataFrame
    key: str
    removed: str | None
    at: str


@dataclass(frozen=True)
class Reference:
    """A column of a child table that refers to ``parent``."""

    name: str
    rows: DataFrame
    key: str
    reference: str
    parent: str
    at: str


def _parent_rows(parent: Parent) -> DataFrame:
    is_open = F.lit(1) if parent.removed is None else F.col(parent.removed).isNull().cast("int")
    return parent.rows.filter(stated(F.col(parent.key))).select(
        F.lit(parent.name).alias("parent_table"),
        packed(F.col(parent.key)).alias("key"),
        F.lit(1).alias("held"),
        is_open.alias("open"),
        F.coalesce(F.col(parent.at).cast("long"), F.lit(_BEFORE_ALL)).alias("first_at"),
        F.lit(None).cast("long").alias("child_at"),
        F.lit(0).alias("referred"),
    )


def _reference_rows(ref: Reference) -> DataFrame:
    return ref.rows.filter(stated(F.col(ref.reference))).select(
        F.lit(ref.parent).alias("parent_table"),
        packed(F.col(ref.reference)).alias("key"),
        F.lit(ref.name).alias("child_table"),
        packed(F.col(ref.key)).alias("child"),
        F.col(ref.at).cast("long").alias("child_at"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame)
    return united


def unsound_keys(parents: list[Parent], references: list[Reference]) -> DataFrame:
    """Referred keys (packed) with what is known of their parent, for every key
    of which at least one reference is an orphan."""
    children = _union([_reference_rows(r) for r in references]).select(
        "parent_table",
        "key",
        F.lit(0).alias("held"),
        F.lit(0).alias("open"),
        F.lit(None).cast("long").alias("first_at"),
        "child_at",
        F.lit(1).alias("referred"),
    )
    grouped = (
        _union([_parent_rows(p) for p in parents])
        .unionByName(children)
        .groupBy("parent_table", "key")
        .agg(
            F.max("held").alias("held"),
            F.max("open").alias("open"),
            F.min("first_at").alias("first_at"),
            F.min("child_at").alias("least_child_at"),
            F.max("referred").alias("referred"),
        )
    )
    unsound = (
        (F.col("held") == 0) | (F.col("open") == 0) | (F.col("least_child_at") < F.col("first_at"))
    )
    return grouped.filter((F.col("referred") == 1) & F.coalesce(unsound, F.lit(False))).select(
        "parent_table", "key", "held", "open", "first_at"
    )


def _reason() -> Column:
    return (
        F.when(F.col("held") == 0, "missing")
        .when(F.col("open") == 0, "deleted")
        .when(F.col("child_at") < F.col("first_at"), "later")
    )


def orphans(parents: list[Parent], references: list[Reference]) -> DataFrame:
    """Distinct ``child_table, child, period, reason`` of all orphan references."""
    found = (
        _union([_reference_rows(r) for r in references])
        .join(unsound_keys(parents, references), ["parent_table", "key"])
        .select("child_table", "child", utc_month(F.col("child_at")).alias("period"), _reason().alias("reason"))
        .filter(F.col("reason").isNotNull())
        .distinct()
    )
    return found.select("child_table", unpacked(F.col("child")).alias("child"), "period", "reason")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per child table, period and reason."""
    return found.groupBy("child_table", "period", "reason").agg(F.count("*").alias("orphans"))
