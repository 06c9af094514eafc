"""Parent links of unknown depth: roots, depths, paths, descendants, cycles.

Every node has at most one parent link, so the links form trees that end in a
node without a link, or run into a cycle.

1. *Partition-local forests.*  Each partition of the links builds a weighted
   disjoint-set forest over its own links (``forest``) and leaves every node with the
   root of its local tree and the offset to it.
2. *Hierarchical merge.*  What has to be merged are the *root edges*: the links of nodes
   that are the root of another partition's tree, each with its own root and offset,
   one row however many nodes hang below.  While more of them are loose than a task holds
   (``FOREST_LINKS``), rounds join them with each other, which doubles the height that an edge
   covers; the rest are merged as one forest of bounded size.  Then every node gets, by one
   join on its local root, the root and offset of that.
3. *Cycles.*  A forest finds the cycles among its links and leaves their nodes, and those
   that lead there, without an end.  If a round settles no edge, none of the rest has an end:
   if some had a finite depth, so would the edges above it, and one of them would have settled.
4. *Paths.*  A path is read off by traversing parents by position: nodes are
   indexed by (node, steps) and prefixes double like the rounds above, each the
   concatenation of a node's prefix and that of the node the prefix ends in.
5. *Walks without an end.*  They double likewise, but stop at the first repeated
   key: pairs (node, ancestor) that are known are not found again.  ``paths`` and
   ``descendants`` hold ended links only, ``all_paths`` and ``all_descendants`` both.

Each round is written to the shared folder, so lineage stays short and a lost
executor costs one round.  Joins are sort-merge on a unique right side; a parent
with a third of all children makes a skewed left partition, which adaptive
execution splits.

Cases: null or empty nodes and parents are no links; repeated links are one; if
a node has several parents the least is followed; a self-link is a cycle; a
parent that is itself no row is a root; no links give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.functions.keys import packed, stated, unpacked
from stelae.session import Scratch

NO_END = -1


#: Links per forest.  A larger partition has several, which are merged like those of other partitions.
FOREST_LINKS = 500_000
_FOREST = "node binary, at binary, steps long, state string"
OPEN, ENDED, ENDLESS = "open", "ended", "endless"


def forest(nodes: pa.Array, parents: pa.Array, steps: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Root, offset to it, and whether there is none, of every node of a set of weighted links.

    Nodes are distinct; a root is a parent without a link in the set.  All nodes follow
    their pointers at once and then point to where these pointed, so a set is as
    deep as one after about log2 of its links rounds; what points into the set still, has no end.
    """
    count = len(nodes)
    coded = pc.dictionary_encode(pa.concat_arrays([nodes, parents]))  # nodes are 0 .. count - 1
    root = np.arange(len(coded.dictionary))
    root[:count] = coded.indices.to_numpy(zero_copy_only=False)[count:]
    offset = np.zeros(len(root), np.int64)
    offset[:count] = steps
    for _ in range(count.bit_length() + 1):
        further = root[root]
        if (further == root).all():
            break
        offset += offset[root]
        root = further
    endless = root[:count] < count
    return coded.dictionary.take(pa.array(root[:count])), np.where(endless, NO_END, offset[:count]), endless


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_FOREST`` of ``node, parent, steps``, a forest at a time."""
    held: list[pa.RecordBatch] = []

    def rooted() -> pa.RecordBatch:
        links = pa.Table.from_batches(held).combine_chunks()
        nodes, parents = links.column(0).combine_chunks(), links.column(1).combine_chunks()
        root, offset, endless = forest(nodes, parents, links.column(2).to_numpy())
        gone = pa.array(endless)
        state = pc.if_else(gone, ENDLESS, OPEN)
        return pa.RecordBatch.from_arrays(
            [nodes, pc.if_else(gone, pa.scalar(None, pa.binary()), root), pa.array(offset), state], names=["node", "at", "steps", "state"]
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= FOREST_LINKS:
            yield rooted()
            held = []
    if held:
        yield rooted()


def links_of(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """One packed link ``node, parent`` per node that has any."""
    return (
        rows.filter(stated(F.col(node)) & stated(F.col(parent)))
        .select(packed(F.col(node)).alias("node"), packed(F.col(parent)).alias("parent"))
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )


def _beyond(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``edges`` with their open ends moved on to where ``targets`` lead; an open end that is
    no node of ``targets`` has ended."""
    above = targets.select(
        F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("state").alias("_state")
    )
    done = edges.filter(F.col("state") != OPEN)
    moved = edges.filter(F.col("state") == OPEN).join(above, "at", "left")
    return done.unionByName(
        moved.select(
            "node",
            F.when(F.col("_state").isNull(), F.col("at")).otherwise(F.col("_at")).alias("at"),
            F.when(F.col("_state") == ENDLESS, F.lit(NO_END))
            .otherwise(F.col("steps") + F.coalesce(F.col("_steps"), F.lit(0)))
            .cast("long")
            .alias("steps"),
            F.coalesce("_state", F.lit(ENDED)).alias("state"),
        )
    )


def _merged(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Root edges with their final ends."""
    step, loose = 0, edges.filter(F.col("state") == OPEN).count()
    while loose > FOREST_LINKS:
        step += 1
        edges = scratch.keep(_beyond(edges, edges), f"edges-{step}")
        left = edges.filter(F.col("state") == OPEN).count()
        if left == loose:  # all that is left leads to cycles
            endless = F.col("state") == OPEN
            return edges.select(
                "node", F.when(~endless, F.col("at")).alias("at"), F.when(endless, F.lit(NO_END)).otherwise(F.col("steps")).cast("long").alias("steps"),
                F.when(endless, F.lit(ENDLESS)).otherwise(F.col("state")).alias("state"),
            )
        loose = left
    links = edges.filter(F.col("state") == OPEN).select("node", F.col("at").alias("parent"), "steps")
    one = scratch.keep(links.repartition(1).mapInArrow(_forests, _FOREST), "merged")  # at most FOREST_LINKS rows
    settled = edges.filter(F.col("state") != OPEN)
    return settled.unionByName(_beyond(one, settled))


def resolve(links: DataFrame) -> DataFrame:
    """``node, root, depth`` (keys packed) of every node with a link.

    ``root`` is null and ``depth`` -1 where the links never end.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    weighted = links.select("node", "parent", F.lit(1).cast("long").alias("steps"))
    known = scratch.keep(weighted.mapInArrow(_forests, _FOREST), "forests")
    local_roots = known.filter(F.col("state") == OPEN).select(F.col("at").alias("node")).distinct()
    edges = scratch.keep(known.join(local_roots, "node", "left_semi"), "edges-0")
    resolved = _beyond(known, _merged(edges, scratch))
    ended = F.col("state") == ENDED
    result = resolved.select(
        "node",
        F.when(ended, F.col("at")).alias("root"),
        F.when(ended, F.col("steps")).otherwise(F.lit(NO_END)).cast("long").alias("depth"),
    )
    return scratch.keep(result, "resolved")


def roots(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root, depth`` with plain keys; ``root`` is '' where the links never end."""
    return resolve(links_of(rows, node, parent)).select(
        unpacked(F.col("node")).alias("node"),
        F.coalesce(unpacked(F.col("root")), F.lit("")).alias("root"),
        "depth",
    )


def ancestors(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """``node, distance, ancestor`` (packed) for every proper ancestor of every
    node whose links end, one row each: the path in long form, and read the
    other way all descendants of a node.  Nodes without an end are left out.

    Distances 1..m give m+1..2m by one join on the ancestor at distance m, so
    the rounds double and no list is ever held for a node with many descendants.
    """
    scratch = Scratch(links.sparkSession, "ancestors")
    ending = resolved.filter(F.col("depth") > 0).select("node", "depth")
    near = links.join(ending, "node").select(
        "node", F.lit(1).cast("long").alias("distance"), F.col("parent").alias("ancestor"), "depth"
    )
    held = scratch.keep(near, "reach-1")
    deepest = ending.agg(F.max("depth")).first()[0] or 0
    reach, parts = 1, [held]
    everything = held
    while reach < deepest:
        ends = everything.filter((F.col("distance") == reach) & (F.col("depth") > reach)).select(
            F.col("node").alias("low"), F.col("ancestor").alias("node"), F.col("depth").alias("low_depth")
        )
        further = ends.join(everything.select("node", "distance", "ancestor"), "node").select(
            F.col("low").alias("node"),
            (F.col("distance") + reach).alias("distance"),
            "ancestor",
            F.col("low_depth").alias("depth"),
        )
        reach *= 2
        parts.append(scratch.keep(further, f"reach-{reach}"))
        everything = everything.unionByName(parts[-1])
    return everything.select("node", "distance", "ancestor")


def endless_ancestors(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """``node, distance, ancestor`` (packed) of the nodes whose links never end: each
    distinct ancestor at its least distance, a node on a cycle among its own.

    A walk repeats nothing until it repeats everything, so the distances kept are
    1..k without a hole, and a node without one at distance m is complete.
    """
    scratch, reach = Scratch(links.sparkSession, "endless"), 1
    endless = resolved.filter(F.col("depth") == NO_END).select("node")
    near = links.join(endless, "node").select(
        "node", F.lit(1).cast("long").alias("distance"), F.col("parent").alias("ancestor")
    )
    found = frontier = scratch.keep(near, "reach-1")
    while not frontier.isEmpty():
        ends = found.filter(F.col("distance") == reach).select(F.col("node").alias("low"), F.col("ancestor").alias("node"))
        further = (
            ends.join(found, "node")
            .select(F.col("low").alias("node"), (F.col("distance") + reach).alias("distance"), "ancestor")
            .join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
            .select("node", "distance", "ancestor")
        )
        reach *= 2
        frontier = scratch.keep(further, f"reach-{reach}")
        found = found.unionByName(frontier)
    return found


def paths(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root, depth, path, endless``: the path as an array from the node
    to its root, empty where the links never end (``endless`` is then true)."""
    links = links_of(rows, node, parent)
    resolved = resolve(links)
    steps = (
        ancestors(links, resolved)
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))).alias("steps"))
    )
    return resolved.join(steps, "node", "left").select(
        unpacked(F.col("node")).alias("node"),
        F.coalesce(unpacked(F.col("root")), F.lit("")).alias("root"),
        "depth",
        F.when(F.col("depth") == NO_END, F.array().cast("array<string>"))
        .otherwise(
            F.concat(
                F.array(unpacked(F.col("node"))),
                F.transform("steps", lambda s: unpacked(s["ancestor"])),
            )
        )
        .alias("path"),
        (F.col("depth") == NO_END).alias("endless"),
    )


def descendants(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, descendant, distance``: all nodes that lead to ``node``, long form."""
    links = links_of(rows, node, parent)
    return ancestors(links, resolve(links)).select(
        unpacked(F.col("ancestor")).alias("node"),
        unpacked(F.col("node")).alias("descendant"),
        "distance",
    )


def _all_ancestors(links: DataFrame, resolved: DataFrame) -> DataFrame:
    return ancestors(links, resolved).unionByName(endless_ancestors(links, resolved))


def all_paths(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root, depth, path, endless`` as ``paths``, but where the links never
    end the path runs to the last key before one is repeated."""
    links = links_of(rows, node, parent)
    resolved = resolve(links)
    steps = (
        _all_ancestors(links, resolved)
        .filter(F.col("ancestor") != F.col("node"))
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))).alias("steps"))
    )
    onward = F.transform("steps", lambda s: unpacked(s["ancestor"]))
    return resolved.join(steps, "node", "left").select(
        unpacked(F.col("node")).alias("node"),
        F.coalesce(unpacked(F.col("root")), F.lit("")).alias("root"),
        "depth",
        F.concat(F.array(unpacked(F.col("node"))), F.coalesce(onward, F.array().cast("array<string>"))).alias("path"),
        (F.col("depth") == NO_END).alias("endless"),
    )


def all_descendants(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, descendant, distance`` as ``descendants``, on and before cycles too;
    a node on a cycle leads to itself."""
    links = links_of(rows, node, parent)
    return _all_ancestors(links, resolve(links)).select(
        unpacked(F.col("ancestor")).alias("node"),
        unpacked(F.col("node")).alias("descendant"),
        "distance",
    )
