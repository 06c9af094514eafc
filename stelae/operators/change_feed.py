"""Applying a feed of inserts, updates and deletes to a base table.

A change carries the whole new state of its subject, so the last change in the
feed's order decides alone.  The order is given by columns, never by arrival:
late, repeated and shuffled arrivals give the same table.  Three steps:

1. ``deduplicated``: every change once by its identifier, combined on the map side.
2. ``latest_changes``: per subject the last change, by a ranking.  ``row_number() = 1``
   is planned by Catalyst with a group limit on both sides of the exchange, so every
   map task sends at most one row of a subject, and a subject with a third of all
   changes costs no more than any other.
3. ``merged``: the last changes joined with the base by subject; the newer row stays.
   The base is neither ranked nor sorted by order again.

Cases: an absent order value precedes every present one; a change that repeats an
identifier with other contents, and changes of equal order, are settled by order,
presence and state, in that sequence, the greatest first, so that any arrival
gives the same row; an operation that is not recognised (or
null) is not applied and is returned by ``unrecognised``; a subject with a null
key column is a subject like any other; a change without an identifier is known by its
subject and order; an empty feed leaves the base as it is, an empty base takes the feed's
rows; further columns of the feed are carried along only if named in ``state``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accepted spellings of the operations, in lower case.
INSERTS = ("i", "insert", "c", "create")
UPDATES = ("u", "update")
DELETES = ("d", "delete")


def operation(op: Column) -> Column:
    """``insert``, ``update`` or ``delete``; null where not recognised."""
    word = F.lower(F.trim(op))
    return (
        F.when(word.isin(*INSERTS), F.lit("insert"))
        .when(word.isin(*UPDATES), F.lit("update"))
        .when(word.isin(*DELETES), F.lit("delete"))
    )


def unrecognised(changes: DataFrame, op: str = "op") -> DataFrame:
    """The changes that ``latest_changes`` leaves out."""
    return changes.filter(operation(F.col(op)).isNull())


def _settled(order: Sequence[str], state: Sequence[str]) -> Column:
    """What decides between rows of one subject: order, presence, state; nulls are least."""
    return F.struct(*(F.col(c) for c in order), (~F.col("deleted")).alias("_present"), *(F.col(c) for c in state))


def deduplicated(
    changes: DataFrame, subject: Sequence[str], identity: Sequence[str], order: Sequence[str], state: Sequence[str], op: str = "op"
) -> DataFrame:
    """Every recognised change once per ``subject`` and ``identity``: its key, its order
    values, ``deleted`` and its state."""
    verb = operation(F.col(op))
    rows = changes.filter(verb.isNotNull()).select(
        *dict.fromkeys([*subject, *identity, *order, *state]), (verb == "delete").alias("deleted")
    )
    once = rows.groupBy(*dict.fromkeys([*subject, *identity])).agg(F.max(_settled(order, state)).alias("_change"))
    return once.select(
        *subject, *(F.col("_change")[c].alias(c) for c in order), *(F.col("_change")[c].alias(c) for c in state),
        (~F.col("_change")["_present"]).alias("deleted"),
    )


def latest_changes(
    changes: DataFrame,
    subject: Sequence[str],
    order: Sequence[str],
    state: Sequence[str],
    op: str = "op",
    base: DataFrame | None = None,
    identity: Sequence[str] | None = None,
) -> DataFrame:
    """One row per subject: its key, its order values, its state and ``deleted``.

    ``identity`` names the columns that identify a change of a subject, by default its
    order.  ``base`` is an earlier result of this function.  Deleted subjects stay in
    the result with ``deleted`` true, so that a change which arrives later but
    is older than the delete cannot bring the subject back; ``present`` drops
    them.
    """
    once = deduplicated(changes, subject, order if identity is None else identity, order, state, op)
    last = Window.partitionBy(*subject).orderBy(_settled(order, state).desc())
    ranked = once.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") == 1).drop("_rank")
    return ranked if base is None else merged(base, ranked, subject, order, state)


def merged(base: DataFrame, latest: DataFrame, subject: Sequence[str], order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """``latest`` merged into ``base``, both with one row per subject: of two rows the
    greater by order, presence and state."""
    columns = [*subject, *order, *state, "deleted"]
    row = lambda rows, name: rows.select(
        *(F.col(c).alias(f"{name}_{n}") for n, c in enumerate(subject)), F.struct(_settled(order, state).alias("at"), F.struct(*columns).alias("row")).alias(name)
    )
    same = [F.col(f"_old_{n}").eqNullSafe(F.col(f"_new_{n}")) for n in range(len(subject))]
    both = row(base, "_old").join(row(latest, "_new"), same, "full")
    old, new = F.col("_old"), F.col("_new")
    kept = F.when(new.isNull(), old).when(old.isNull() | (new["at"] > old["at"]), new).otherwise(old)
    return both.select(kept["row"].alias("_kept")).select(*(F.col("_kept")[c].alias(c) for c in columns))


def present(latest: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The subjects that are present, without ``deleted`` and the order columns."""
    return latest.filter(~F.col("deleted")).drop("deleted", *order)
