"""Queries of the core operators over change feeds, references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.operators import change_feed, hierarchy, references
from stelae.session import Scratch, hadoop_path
from stelae.sources.tables import table
from stelae.streaming.live import LiveTable

_SUBJECT, _ORDER, _STATE = ["kind", "id"], ["at_seconds", "seq"], ["standing", "successor"]


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """The feed in two deliveries: what arrived in the first half of the time becomes the
    base, and what arrived later, late changes of early times among it, is merged into it."""
    feed = table(spark, folder, "publications")
    bounds = feed.agg(F.min("arrived_at").alias("first"), F.max("arrived_at").alias("last")).first()
    applied = lambda rows, base=None: change_feed.latest_changes(rows, _SUBJECT, _ORDER, _STATE, base=base, identity=["seq"])
    if bounds.first is None:
        return applied(feed)
    early = F.coalesce(F.col("arrived_at") <= F.lit(bounds.first + (bounds.last - bounds.first) / 2), F.lit(False))
    base = Scratch(spark, "feed").keep(applied(feed.filter(early)), "base")
    return applied(feed.filter(~early), base)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return change_feed.present(_latest(spark, folder), _ORDER).withColumn(
        "successor", F.coalesce("successor", F.lit(""))
    )


def live_standings(spark: SparkSession, folder: str) -> DataFrame:
    """The feed as a stream, file by file, into a table that is kept current."""
    scratch, feed = Scratch(spark, "live"), table(spark, folder, "publications")
    live = LiveTable(spark, scratch.path("table"), _SUBJECT, _ORDER, _STATE, identity=["seq"])
    name = "publications.parquet"
    where, files = hadoop_path(spark, f"{folder}/{name}")
    reader = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1)
    # A stream watches a folder: the table's own, or the one in which its only file lies.
    stream = reader.parquet(f"{folder}/{name}") if files.getFileStatus(where).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
    live.start(stream, scratch.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return change_feed.present(live.current(), _ORDER).withColumn("successor", F.coalesce("successor", F.lit("")))


def p2_standings(spark: SparkSession, folder: str) -> DataFrame:
    """Present and deleted subjects per kind and standing."""
    return (
        _latest(spark, folder)
        .groupBy("kind", F.coalesce("standing", F.lit("")).alias("standing"), "deleted")
        .agg(F.count("*").alias("subjects"))
    )


def _references(spark: SparkSession, folder: str):
    concepts, claims = table(spark, folder, "concepts"), table(spark, folder, "claims")
    assertions = table(spark, folder, "assertions")
    parents = [
        references.Parent("concepts", concepts, "concept", "removed_at", "at_seconds"),
        references.Parent("claims", claims, "claim", "removed_at", "at_seconds"),
    ]
    children = [
        references.Reference("claims", claims, "claim", "concept", "concepts", "at_seconds"),
        references.Reference("assertions", assertions, "assertion", "claim", "claims", "at_seconds"),
    ]
    return parents, children


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans(*_references(spark, folder))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_counts(p4_found(spark, folder))


def _superseded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "concepts").filter(
        F.col("removed_at").isNull() & (F.col("standing") == "superseded")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.roots(_superseded(spark, folder), "concept", "successor").withColumnRenamed(
        "node", "concept"
    )


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path of every superseded concept, joined by ' > '."""
    return hierarchy.paths(_superseded(spark, folder), "concept", "successor").select(
        F.col("node").alias("concept"), "root", "depth", F.concat_ws(" > ", "path").alias("path"), "endless"
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(_superseded(spark, folder), "concept", "successor").withColumnRenamed(
        "node", "concept"
    )


def p5_all_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path of every superseded concept; up to the first repeated one where it never ends."""
    return hierarchy.all_paths(_superseded(spark, folder), "concept", "successor").select(
        F.col("node").alias("concept"), "root", "depth", F.concat_ws(" > ", "path").alias("path"), "endless"
    )


def p5_all_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All concepts that lead to a concept, whether their links end or not."""
    return hierarchy.all_descendants(_superseded(spark, folder), "concept", "successor").withColumnRenamed(
        "node", "concept"
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_standings": p2_standings,
    "live_standings": live_standings,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
    "p5_all_paths": p5_all_paths,
    "p5_all_descendants": p5_all_descendants,
}

_LATEST_SQL = """
latest AS (
  SELECT kind, id, standing, successor, lower(op) IN ('d', 'delete') AS deleted
  FROM publications
  QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY at_seconds DESC NULLS LAST, seq DESC) = 1
)"""

_ORPHANS_SQL = """
parents AS (
  SELECT 'concepts' AS t, concept AS k, removed_at, at_seconds FROM concepts
  UNION ALL SELECT 'claims', claim, removed_at, at_seconds FROM claims
),
held AS (
  SELECT t, k, bool_or(removed_at IS NULL) AS is_open,
         min(coalesce(at_seconds, -9223372036854775808)) AS first_at
  FROM parents GROUP BY ALL
),
children AS (
  SELECT 'claims' AS child_table, claim AS child, 'concepts' AS t, concept AS k, at_seconds FROM claims
  UNION ALL SELECT 'assertions', assertion, 'claims', claim, at_seconds FROM assertions
),
found AS (
  SELECT DISTINCT child_table, child,
    CASE WHEN c.at_seconds IS NULL THEN 'untimed'
         ELSE strftime(make_timestamp(c.at_seconds * 1000000), '%Y-%m') END AS period,
    CASE WHEN h.k IS NULL THEN 'missing' WHEN NOT is_open THEN 'deleted'
         WHEN c.at_seconds < first_at THEN 'later' END AS reason
  FROM children c LEFT JOIN held h ON c.t = h.t AND c.k = h.k
  WHERE c.k IS NOT NULL AND c.k <> ''
)"""

_CHAINS_SQL = """
links AS (
  SELECT concept, min(successor) AS successor FROM concepts
  WHERE removed_at IS NULL AND standing = 'superseded' AND successor <> '' GROUP BY 1
),
chains AS (
  SELECT concept, successor AS root, 1 AS depth, concept || ' > ' || successor AS path
  FROM links WHERE successor NOT IN (SELECT concept FROM links)
  UNION ALL
  SELECT l.concept, c.root, c.depth + 1, l.concept || ' > ' || c.path
  FROM links l JOIN chains c ON l.successor = c.concept
)"""

_WALKS_SQL = f"""{_CHAINS_SQL},
walks AS (
  SELECT concept, successor AS reached, 1 AS distance, [successor] AS seen FROM links
  UNION ALL
  SELECT w.concept, l.successor, w.distance + 1, list_append(w.seen, l.successor)
  FROM walks w JOIN links l ON w.reached = l.concept
  WHERE NOT list_contains(w.seen, l.successor)
)"""

ORACLE = {
    "live_standings": f"WITH {_LATEST_SQL} SELECT kind, id, standing, coalesce(successor, '') AS successor FROM latest WHERE NOT deleted",
    "p2_found": f"WITH {_LATEST_SQL} SELECT kind, id, standing, coalesce(successor, '') AS successor FROM latest WHERE NOT deleted",
    "p2_standings": f"WITH {_LATEST_SQL} SELECT kind, coalesce(standing, '') AS standing, deleted, count(*) AS subjects FROM latest GROUP BY ALL",
    "p4_found": f"WITH {_ORPHANS_SQL} SELECT * FROM found WHERE reason IS NOT NULL",
    "p4_report": f"WITH {_ORPHANS_SQL} SELECT child_table, period, reason, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": f"""WITH RECURSIVE {_CHAINS_SQL}
SELECT l.concept, coalesce(c.root, '') AS root, coalesce(c.depth, -1)::BIGINT AS depth
FROM links l LEFT JOIN chains c USING (concept)""",
    "p5_paths": f"""WITH RECURSIVE {_CHAINS_SQL}
SELECT l.concept, coalesce(c.root, '') AS root, coalesce(c.depth, -1)::BIGINT AS depth,
       coalesce(c.path, '') AS path, c.path IS NULL AS endless
FROM links l LEFT JOIN chains c USING (concept)""",
    "p5_descendants": f"""WITH RECURSIVE {_CHAINS_SQL},
steps AS (SELECT concept AS descendant, unnest(string_split(path, ' > ')) AS concept,
                 unnest(range(0, depth + 1)) AS distance FROM chains)
SELECT concept, descendant, distance::BIGINT AS distance FROM steps WHERE distance > 0""",
    "p5_all_paths": f"""WITH RECURSIVE {_WALKS_SQL}
SELECT w.concept, coalesce(c.root, '') AS root, coalesce(c.depth, -1)::BIGINT AS depth,
       array_to_string(list_prepend(w.concept, list_filter(w.seen, lambda k: k <> w.concept)), ' > ') AS path,
       c.concept IS NULL AS endless
FROM (SELECT * FROM walks QUALIFY row_number() OVER (PARTITION BY concept ORDER BY distance DESC) = 1) w
LEFT JOIN chains c USING (concept)""",
    "p5_all_descendants": f"""WITH RECURSIVE {_WALKS_SQL}
SELECT reached AS concept, concept AS descendant, distance::BIGINT AS distance FROM walks""",
}
