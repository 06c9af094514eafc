"""Typed relations: the type kernel and closure over certified kinds.

A kernel is a table ``type, parent, layer``: one root (without parent), no cycle,
one layer per type.  Only kinds that are certified transitive are closed; nothing
is inferred over any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.functions.keys import stated
from stelae.operators import hierarchy
from stelae.session import Scratch


# The kinds of relations, nine that tell connections apart and twelve that
# type what disciplines declare, and the properties a relation can have.
KINDS = (
    "identity", "formal correspondence", "causal explanation", "historical influence", "method transfer", "analogy",
    "interpretation", "metaphor", "coincidence",
    "taxonomic", "compositional", "dependency", "logical", "evidential", "normative", "representational", "functional",
    "temporal", "contextual", "contradiction", "contrast",
)
PROPERTIES = (
    "symmetric", "antisymmetric", "transitive", "reflexive", "functional", "inverse_functional", "temporal", "contextual",
    "definitional", "destructive", "confidence_bearing", "negative_knowledge",
)
RELATIONS = "relation string, kind string, " + ", ".join(f"{p} boolean" for p in PROPERTIES)
#: What a kind demands of its relations: ``demanded`` true requires a property, false forbids it.
DEMANDS = "kind string, property string, demanded boolean"
#: An equivalence: the only kind whose members may be grouped.
IDENTITY_DEMANDS = (("identity", "reflexive", True), ("identity", "symmetric", True), ("identity", "transitive", True))


def algebra_faults(declared: DataFrame, demands: DataFrame) -> DataFrame:
    """``relation, property, fault`` of declared relations (``RELATIONS``) that break what their
    kind demands, are of no known kind, or of a kind that demands nothing at all.

    A property that is not stated is not given: it breaks a requirement and keeps a prohibition.
    """
    long = declared.unpivot(["relation", "kind"], list(PROPERTIES), "property", "given").withColumn("given", F.coalesce("given", F.lit(False)))
    broken = long.join(demands, ["kind", "property"]).filter(F.col("given") != F.col("demanded"))
    faults = broken.select("relation", "property", F.when(F.col("demanded"), F.lit("required")).otherwise(F.lit("forbidden")).alias("fault"))
    none = F.lit(None).cast("string").alias("property")
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    unknown = declared.filter(~known).select("relation", none, F.lit("of no known kind").alias("fault"))
    idle = declared.filter(known).join(demands.select("kind").distinct(), "kind", "left_anti")
    return faults.unionByName(unknown).unionByName(idle.select("relation", none, F.lit("of a kind that demands nothing").alias("fault")))


def certified(declared: DataFrame, demands: DataFrame) -> DataFrame:
    """``relation``: those that may be closed over, transitive themselves and of a kind that
    requires it, and without a fault."""
    required = demands.filter((F.col("property") == "transitive") & F.col("demanded")).select("kind").distinct()
    sound = declared.filter("transitive").join(required, "kind", "left_semi")
    return sound.join(algebra_faults(declared, demands).select("relation"), "relation", "left_anti").select("relation")


def kernel_faults(types: DataFrame) -> DataFrame:
    """``type, fault``: further roots, types on or under a cycle, parents that are no
    type, types with several layers.  No row for a sound kernel; an empty kernel
    has none either."""
    known = types.filter(stated(F.col("type")))
    tops = known.filter(~F.coalesce(stated(F.col("parent")), F.lit(False))).select("type").distinct()
    first = tops.agg(F.min("type")).first()[0]
    several = tops.filter(F.col("type") != first).select("type", F.lit("a second root").alias("fault"))
    resolved = hierarchy.roots(known, "type", "parent")
    cyclic = resolved.filter("depth = -1").select(F.col("node").alias("type"), F.lit("in a cycle").alias("fault"))
    named = known.filter(stated(F.col("parent"))).select("type", "parent")
    lost = named.join(known.select(F.col("type").alias("parent")), "parent", "left_anti").select("type", F.lit("an unknown parent").alias("fault"))
    layered = known.groupBy("type").agg(F.count_distinct("layer").alias("n")).filter("n > 1").select("type", F.lit("several layers").alias("fault"))
    return several.unionByName(cyclic).unionByName(lost).unionByName(layered).distinct()


def closure(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``kind, source, target`` reachable along ``source, kind, target`` edges of the
    certified ``kinds``; edges of other kinds are returned as they are.

    Each round joins the pairs that the last round found with all pairs known, so
    the distance covered doubles; rounds are written, and a cycle ends because
    known pairs are not found again.
    """
    scratch, step = Scratch(edges.sparkSession, "closure"), 0
    clean = edges.filter(stated(F.col("source")) & stated(F.col("target"))).select("kind", "source", "target").distinct()
    direct = scratch.keep(clean, "direct")
    base = direct.filter(F.col("kind").isin(*kinds))
    found = frontier = base
    while not frontier.isEmpty():
        step += 1
        onward = found.select("kind", F.col("source").alias("target"), F.col("target").alias("beyond"))
        reached = (
            frontier.join(onward, ["kind", "target"])
            .select("kind", "source", F.col("beyond").alias("target"))
            .distinct()
            .join(found, ["kind", "source", "target"], "left_anti")
        )
        frontier = scratch.keep(reached, f"reached-{step}")
        found = found.unionByName(frontier)
    return found.unionByName(direct.filter(~F.col("kind").isin(*kinds)))
