"""Percentiles of very large columns from mergeable compactor hierarchies.

A sketch is a hierarchy of buffers; a value in the buffer at height h stands for
2**h values.  When the buffers hold more than they may, the lowest full one is
sorted and every other value moves one level up, starting with the first or the
second by a coin.  Two sketches merge level by level, so sketches of partitions,
days or earlier runs combine into the sketch of the whole.

Error.  A compaction at height h moves the rank of any fixed value by +2**h,
-2**h or 0, with mean 0.  A sketch carries ``variance``, the sum of 4**h over
all its compactions, and by Hoeffding's inequality a rank it answers is off by
more than ``sqrt(2 * variance * ln(2 / delta))`` with probability at most
``delta``.  That bound over n is the column ``rank_error``; it is 0, the answer
exact, while nothing was compacted.  With ``k = 512`` and ``delta = 1e-6`` it
stays below 0.02 for any n (``tests/llm/test_quantiles.py``).

Coins.  The bound needs coins that are independent of the values and of each other.
A sketch tosses them from the name it is made under (seed, step, task, group and
metric) and the number of its compactions, so no two sketches share coins, equal
buffers or not, and a task that is repeated gives the same sketch, its values being sorted
with their groups.  Sketches of several tables that are to be merged take several seeds.

Plan.  Rows are first sorted by group inside their partitions (no shuffle of
values), every task builds one sketch per group it sees, and only sketches are
shuffled, so a group with a third of all rows costs a task one bounded row.
They are merged in two steps: first those of ``FAN_IN`` neighbouring tasks, then the
results, so that of a group that a million tasks see no task merges more than
about a thousand sketches.

Cases: nulls are left out and a group of nothing but nulls has no row; a null
key is a group of its own; ties, zeros and extreme values need no care, values
are compared as 64-bit integers; the p-percentile of n values is the value of
rank ceil(p * n), at least 1; an empty table gives no row; other columns are
ignored, and a key may not be named like a sketch column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 512
FAN_IN = 1_024
DELTA = 1e-6
_SHRINK = 2 / 3
_LEAST = 8
_SKETCH = "metric string, n long, low long, high long, variance double, sizes array<int>, items binary, part int"


class Compactors:
    """One sketch.  ``levels[h]`` holds values of weight 2**h."""

    __slots__ = ("k", "n", "low", "high", "variance", "levels", "name", "tossed")

    def __init__(self, k: int = K, name: tuple = ()):
        self.k, self.n, self.low, self.high, self.variance = k, 0, None, None, 0.0
        self.name, self.tossed = repr(name).encode(), 0
        self.levels: list[np.ndarray] = [np.empty(0, np.int64)]

    def _capacity(self, height: int) -> int:
        return max(_LEAST, math.ceil(self.k * _SHRINK ** (len(self.levels) - 1 - height)))

    def _coin(self) -> int:
        """64 coins of this sketch's next compaction."""
        self.tossed += 1
        return xxhash.xxh3_64_intdigest(self.name, seed=self.tossed)

    def _compact(self) -> None:
        while sum(map(len, self.levels)) > sum(map(self._capacity, range(len(self.levels)))):
            height = next(h for h, level in enumerate(self.levels) if len(level) > self._capacity(h))
            if height + 1 == len(self.levels):
                self.levels.append(np.empty(0, np.int64))
            ordered = np.sort(self.levels[height], kind="stable")
            coin = self._coin()
            odd = len(ordered) % 2
            if odd:  # one value stays, at one end or the other
                rest = ordered[:1] if coin & 2 else ordered[-1:]
                ordered = ordered[1:] if coin & 2 else ordered[:-1]
            self.levels[height] = rest if odd else np.empty(0, np.int64)
            self.levels[height + 1] = np.concatenate([self.levels[height + 1], ordered[coin & 1 :: 2]])
            self.variance += 4.0**height

    def update(self, values: np.ndarray) -> None:
        """Add values, a bounded block at a time."""
        for start in range(0, len(values), 4 * self.k):
            block = values[start : start + 4 * self.k]
            self.n += len(block)
            low, high = int(block.min()), int(block.max())
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)
            self.levels[0] = np.concatenate([self.levels[0], block])
            self._compact()

    def merge(self, other: Compactors) -> None:
        """Add another sketch, level by level."""
        if not other.n:
            return
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0, np.int64))
        for height, level in enumerate(other.levels):
            if len(level):
                self.levels[height] = np.concatenate([self.levels[height], level])
        self.low = other.low if self.low is None else min(self.low, other.low)
        self.high = other.high if self.high is None else max(self.high, other.high)
        self.n += other.n
        self.variance += other.variance
        self._compact()

    def percentiles(self, ps: Sequence[float]) -> list[int | None]:
        if not self.n:
            return [None] * len(ps)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        reached = np.cumsum(weights[order])
        out = []
        for p in ps:
            if p <= 0:
                out.append(self.low)
            elif p >= 1:
                out.append(self.high)
            else:
                rank = max(1, math.ceil(p * self.n - 1e-9))
                at = min(int(np.searchsorted(reached, rank)), len(values) - 1)
                out.append(int(values[order[at]]))
        return out

    def rank_error(self, delta: float = DELTA) -> float:
        return math.sqrt(2 * self.variance * math.log(2 / delta)) / self.n if self.n else 0.0

    def row(self) -> tuple:
        return self.n, self.low, self.high, self.variance, [len(v) for v in self.levels], np.concatenate(self.levels).tobytes()

    @classmethod
    def of_row(cls, k: int, n: int, low: int, high: int, variance: float, sizes: list[int], items: bytes) -> Compactors:
        sketch = cls(k)
        sketch.n, sketch.low, sketch.high, sketch.variance = n, low, high, variance
        sketch.levels = np.split(np.frombuffer(items, np.int64), np.cumsum(sizes)[:-1]) if sizes else sketch.levels
        return sketch


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows of a sorted batch at which the key differs from the row before."""
    differs = np.zeros(batch.num_rows, bool)
    differs[:1] = True
    for i in range(keys):
        codes = pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        differs[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(differs)


def _key(batch: pa.RecordBatch, keys: int, row: int) -> tuple:
    return tuple(batch.column(i)[row].as_py() for i in range(keys))


class _Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.octets = schema, [], 0

    def add(self, row: tuple, octets: int) -> None:
        self.rows.append(row)
        self.octets += octets + 64

    def full(self) -> bool:
        return self.octets > 4_000_000

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in self.schema]
        self.rows, self.octets = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema
        )


def _arrow(df: DataFrame, keys: Sequence[str]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(k, to_arrow_type(df.schema[k].dataType)) for k in keys]


_SKETCH_FIELDS = [
    pa.field("metric", pa.string()), pa.field("n", pa.int64()), pa.field("low", pa.int64()),
    pa.field("high", pa.int64()), pa.field("variance", pa.float64()),
    pa.field("sizes", pa.list_(pa.int32())), pa.field("items", pa.binary()), pa.field("part", pa.int32()),
]


def _builder(schema: pa.Schema, keys: int, metrics: list[str], k: int, seed: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), _Out(schema)
        current, sketches = None, {}

        def close() -> None:
            for metric, sketch in sketches.items():
                if sketch.n:
                    row = sketch.row()
                    out.add((*current, metric, *row, part), len(row[-1]))

        for batch in batches:
            starts = _starts(batch, keys)
            columns = [batch.column(keys + i) for i in range(len(metrics))]
            values = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
            there = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                key = _key(batch, keys, start)
                if key != current:
                    close()
                    current, sketches = key, {m: Compactors(k, (seed, 0, part, key, m)) for m in metrics}
                for metric, v, t in zip(metrics, values, there):
                    part_of = v[start:stop][t[start:stop]]
                    if len(part_of):
                        sketches[metric].update(part_of)
            if out.full():
                yield out.take()
        close()
        yield out.take()

    return build


def _merger(schema: pa.Schema, keys: int, k: int, seed: int, step: int) -> Callable:
    """One sketch per run of equal keys, metric and part."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, current, sketch = TaskContext.get().partitionId(), _Out(schema), None, None

        def close() -> None:
            if sketch is not None:
                row = sketch.row()
                out.add((*current[:-1], *row, current[-1]), len(row[-1]))

        for batch in batches:
            rest = [batch.column(keys + 1 + i).to_pylist() for i in range(6)]
            names = zip(*(batch.column(i).to_pylist() for i in (*range(keys + 1), batch.num_columns - 1)))
            for key, *row in zip(names, *rest):
                if key != current:
                    close()
                    current, sketch = key, Compactors(k, (seed, step, task, key))
                    if out.full():
                        yield out.take()
                sketch.merge(Compactors.of_row(k, *row))
        close()
        yield out.take()

    return merge


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _merge_step(sketches: DataFrame, keys: Sequence[str], part: Column, k: int, seed: int, step: int) -> DataFrame:
    fields = [*_arrow(sketches, keys), *_SKETCH_FIELDS]
    columns = [*keys, *(f.name for f in _SKETCH_FIELDS[:-1])]
    finer = [c for c in sketches.columns if c not in columns and c != "part"]
    return (
        sketches.withColumns({"_told": F.col("part"), "part": part.cast("int")})
        .repartition(*keys, "metric", "part")
        .sortWithinPartitions(*keys, "metric", "part", *finer, "_told")
        .select(*columns, "part")
        .mapInArrow(_merger(pa.schema(fields), len(keys), k, seed, step), _ddl(sketches, keys) + _SKETCH)
    )


def merged(sketches: DataFrame, keys: Sequence[str], k: int = K, seed: int = 0) -> DataFrame:
    """One sketch per ``keys`` and metric, from sketches of any finer grouping."""
    near = _merge_step(sketches, keys, F.floor(F.col("part") / FAN_IN), k, seed, 1 + len(keys) * 2)
    return _merge_step(near, keys, F.lit(0), k, seed, 2 + len(keys) * 2)


def sketched(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int = K, seed: int = 0) -> DataFrame:
    """One sketch per ``keys`` and metric.  The result is an ordinary table: kept
    per day, it is combined later by ``merged``."""
    fields = pa.schema([*_arrow(rows, keys), *_SKETCH_FIELDS])
    partial = (
        rows.select(*keys, *(F.col(m).cast("long") for m in metrics))
        .sortWithinPartitions(*keys, *metrics)
        .mapInArrow(_builder(fields, len(keys), list(metrics), k, seed), _ddl(rows, keys) + _SKETCH)
    )
    return merged(partial, keys, k, seed)


def percentiles(sketches: DataFrame, keys: Sequence[str], ps: dict[str, float], k: int = K, delta: float = DELTA) -> DataFrame:
    """``keys``, ``metric``, ``n``, ``low``, ``high``, one column per entry of
    ``ps`` and ``rank_error``."""
    names = list(ps)
    fields = pa.schema(
        [*_arrow(sketches, keys), pa.field("metric", pa.string()), pa.field("n", pa.int64()), pa.field("low", pa.int64()), pa.field("high", pa.int64())]
        + [pa.field(p, pa.int64()) for p in names]
        + [pa.field("rank_error", pa.float64())]
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for row in zip(*(batch.column(len(keys) + 1 + i).to_pylist() for i in range(6))):
                sketch = Compactors.of_row(k, *row)
                answers.append((*sketch.percentiles(list(ps.values())), sketch.rank_error(delta)))
            columns = list(zip(*answers)) if answers else [[] for _ in range(len(names) + 1)]
            plain = [batch.column(i) for i in range(len(keys) + 4)]
            asked = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.float64())]
            yield pa.RecordBatch.from_arrays(plain + asked, schema=fields)

    ddl = _ddl(sketches, keys) + "metric string, n long, low long, high long, " + "".join(f"`{p}` long, " for p in names)
    return sketches.select(*keys, *(f.name for f in _SKETCH_FIELDS[:-1])).mapInArrow(ask, ddl + "rank_error double")


def once_each(rows: DataFrame, identity: str, columns: Sequence[str], delivered: str) -> DataFrame:
    """``columns`` of every row once per ``identity``, the first delivery's; rows
    without an identity are all kept.  Repeats in one task never leave it."""
    named = rows.filter(F.col(identity).isNotNull())
    first = F.min_by(F.struct(*columns), F.struct(F.col(delivered).isNull(), F.col(delivered), *columns))
    kept = named.groupBy(identity).agg(first.alias("_row")).select("_row.*")
    return kept.unionByName(rows.filter(F.col(identity).isNull()).select(*columns))
