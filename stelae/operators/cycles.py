"""Edges of any directed graph that lie on a cycle, in rounds that do not follow its depth.

An edge lies on a cycle where both its ends are in one strong component.

1. *One task.*  Up to ``FOREST_LINKS`` edges are one task's work: its components are found in
   time linear in its edges, however deep the graph is.
2. *Rounds.*  While there are more, edges that nothing leads to or that lead nowhere are dropped, and
   every node learns the least label that reaches it and the least that it reaches.  A label is
   a node in an order drawn anew each time; beside what its neighbours know a node learns what
   the node of its label knows, so what is covered grows by multiples.  Ends of an edge whose labels differ are in
   different components; equal labels that are one and the same node are a component; edges of equal pairs of
   two labels go on.  The least node of all is settled each time, so it ends.

Each round is written to the shared folder.  Rows are edges and nodes, never pairs of a node
and what it leads to.

Cases: an edge of a node to itself is a cycle; null ends are no edge; repeated edges are one, ``asked`` if one
of them is; several ways, several cycles through a node and cycles that share nodes are one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.functions.keys import packed, unpacked
from stelae.operators.hierarchy import FOREST_LINKS
from stelae.session import Scratch


def components(count: int, tails: list[int], heads: list[int]) -> list[int]:
    """The strong component of each of ``count`` nodes, by one depth-first walk without recursion."""
    further: list[list[int]] = [[] for _ in range(count)]
    for tail, head in zip(tails, heads):
        further[tail].append(head)
    place, low, component = [0] * count, [0] * count, [-1] * count
    met, found, open_nodes = 0, 0, []
    for start in range(count):
        if place[start]:
            continue
        walk = [start]
        while walk:
            node = walk[-1]
            if not place[node]:
                met += 1
                place[node] = low[node] = met
                open_nodes.append(node)
            if further[node]:
                head = further[node].pop()
                if not place[head]:
                    walk.append(head)
                elif component[head] < 0:
                    low[node] = min(low[node], place[head])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[node])
            if low[node] == place[node]:
                while component[node] < 0:
                    component[open_nodes.pop()] = found
                found += 1
    return component


def _asked_on_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asked tails of the edges ``tail, head, asked`` of one task that lie on a cycle."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held).combine_chunks()
    tails, heads = edges.column("tail").combine_chunks(), edges.column("head").combine_chunks()
    coded = pc.dictionary_encode(pa.concat_arrays([tails, heads]))
    codes = coded.indices.to_pylist()
    low, high = codes[: len(tails)], codes[len(tails) :]
    component = components(len(coded.dictionary), low, high)
    on = pa.array([component[t] == component[h] for t, h in zip(low, high)], pa.bool_())
    yield pa.RecordBatch.from_arrays([tails.filter(pc.and_(on, edges.column("asked").combine_chunks()))], names=["tail"])


def _labelled(edges: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """``node, down, up``: the least label that reaches each node and the least that it reaches."""
    ends = edges.select(F.explode(F.array("tail", "head")).alias("node")).distinct()
    label = F.struct(F.xxhash64("node", F.lit(turn)).alias("drawn"), "node")
    known = scratch.keep(ends.select("node", label.alias("down"), label.alias("up"), F.lit(True).alias("moved")), f"labels-{turn}-0")
    step, none = 0, F.lit(None).cast("struct<drawn: bigint, node: binary>")
    while not known.filter("moved").isEmpty():
        step += 1
        other = known.select(F.col("node").alias("_node"), F.col("down").alias("_down"), F.col("up").alias("_up"))
        told = lambda rows, at, of, down, up: rows.join(other, F.col(at) == F.col("_node")).select(
            F.col(of).alias("node"), (F.col("_down") if down else none).alias("down"), (F.col("_up") if up else none).alias("up"), none.alias("was_down"), none.alias("was_up")
        )
        own = known.select("node", "down", "up", F.col("down").alias("was_down"), F.col("up").alias("was_up"))
        everything = (
            own.unionByName(told(edges, "tail", "head", True, False))
            .unionByName(told(edges, "head", "tail", False, True))
            .unionByName(told(known, "down.node", "node", True, False))
            .unionByName(told(known, "up.node", "node", False, True))
        )
        least = everything.groupBy("node").agg(*(F.min(c).alias(c) for c in ("down", "up", "was_down", "was_up")))
        moved = (F.col("down") != F.col("was_down")) | (F.col("up") != F.col("was_up"))
        known = scratch.keep(least.select("node", "down", "up", moved.alias("moved")), f"labels-{turn}-{step}")
        if step > 1:
            scratch.drop(f"labels-{turn}-{step - 2}")
    return known.select("node", F.col("down.node").alias("down"), F.col("up.node").alias("up"))


def asked_on_cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``tail`` of the ``asked`` edges of ``tail, head, asked`` that lie on a cycle, each once."""
    most, turn = FOREST_LINKS if most is None else most, 0
    scratch = Scratch(edges.sparkSession, "cycles")
    given = edges.filter(F.col("tail").isNotNull() & F.col("head").isNotNull()).select(packed(F.col("tail")).alias("tail"), packed(F.col("head")).alias("head"), "asked")
    left = scratch.keep(given.groupBy("tail", "head").agg(F.max("asked").alias("asked")), "edges-0")
    found = []
    while left.count() > most:
        turn += 1
        led_to, leading = left.select(F.col("head").alias("tail")).distinct(), left.select(F.col("tail").alias("head")).distinct()
        inner = scratch.keep(left.join(led_to, "tail", "left_semi").join(leading, "head", "left_semi").select("tail", "head", "asked"), f"inner-{turn}")
        if inner.count() <= most:
            left = inner
            break
        labels = _labelled(inner, scratch, turn)
        tails = labels.select(F.col("node").alias("tail"), "down", "up")
        heads = labels.select(F.col("node").alias("head"), F.col("down").alias("_down"), F.col("up").alias("_up"))
        same = (F.col("down") == F.col("_down")) & (F.col("up") == F.col("_up"))
        within = scratch.keep(inner.join(tails, "tail").join(heads, "head").filter(same).select("tail", "head", "asked", (F.col("down") == F.col("up")).alias("settled")), f"within-{turn}")
        found.append(within.filter("settled AND asked").select("tail"))
        left = within.filter("NOT settled").select("tail", "head", "asked")
    on = left.repartition(1).mapInArrow(_asked_on_cycles, "tail binary")  # at most ``most`` rows
    for part in found:
        on = on.unionByName(part)
    return on.distinct().select(unpacked(F.col("tail")).alias("tail"))
