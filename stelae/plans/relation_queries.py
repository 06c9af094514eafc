"""Queries of relations, ranked retrieval and comparison of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.operators import ranked, relations
from stelae.plans.graph_queries import _GRAPH, table_graph
from stelae.sources.tables import table

_NEAREST = 10


def relation_closure(spark: SparkSession, folder: str) -> DataFrame:
    """What every concept reaches by supersession, a certified transitive kind, beside
    the claims about it, a kind that is not closed."""
    links = table(spark, folder, "concepts").filter("removed_at IS NULL AND standing = 'superseded'").select(
        F.lit("superseded by").alias("kind"), F.col("concept").alias("source"), F.col("successor").alias("target")
    )
    about = table(spark, folder, "claims").filter("removed_at IS NULL").select(
        F.lit("about").alias("kind"), F.col("claim").alias("source"), F.col("concept").alias("target")
    )
    return relations.closure(links.unionByName(about), ["superseded by"])


def ranked_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest stored vectors of every vector whose id is divisible by 100."""
    rows = table(spark, folder, "embeddings")
    found = ranked.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), _NEAREST)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "neighbour")


def corroboration(spark: SparkSession, folder: str) -> DataFrame:
    """Current claims with their distinct sources, scopes and citations."""
    world = table_graph(spark, folder).current()
    cited = world.assertions().groupBy("claim").agg(
        F.count("*").alias("citations"), F.count_distinct("source").alias("sources"), F.count_distinct("scope").alias("scopes")
    )
    return world.claims().join(cited, "claim", "left").select(
        "claim", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("citations", "sources", "scopes"))
    )


def source_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per source how many current claims it makes, and how many of them others make too."""
    cited = table_graph(spark, folder).current().assertions().select("source", "claim").distinct()
    shared = cited.groupBy("claim").agg(F.count("*").alias("n"))
    return cited.join(shared, "claim").groupBy("source").agg(
        F.count("*").alias("claims"), F.count(F.when(F.col("n") > 1, 1)).alias("shared")
    )


QUERIES = {q.__name__: q for q in (relation_closure, ranked_neighbours, corroboration, source_agreement)}

ORACLE = {
    "relation_closure": """WITH RECURSIVE links AS (
  SELECT DISTINCT concept AS source, successor AS target FROM concepts
  WHERE removed_at IS NULL AND standing = 'superseded' AND concept <> '' AND successor <> ''),
reach AS (SELECT source, target FROM links UNION SELECT r.source, l.target FROM reach r JOIN links l ON r.target = l.source)
SELECT 'superseded by' AS kind, source, target FROM reach
UNION ALL SELECT DISTINCT 'about', claim, concept FROM claims WHERE removed_at IS NULL AND claim <> '' AND concept <> ''""",
    "ranked_neighbours": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT q.vec_id AS query, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, r.e) DESC, r.vec_id) AS rank, r.vec_id AS neighbour
FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= {_NEAREST}""",
    "corroboration": f"""WITH {_GRAPH} SELECT ck.claim, count(assertion) AS citations, count(DISTINCT source) AS sources, count(DISTINCT scope) AS scopes
FROM ck LEFT JOIN ca USING (claim) GROUP BY 1""",
    "source_agreement": f"""WITH {_GRAPH}, cited AS (SELECT DISTINCT source, claim FROM ca), n AS (SELECT claim, count(*) AS n FROM cited GROUP BY 1)
SELECT source, count(*) AS claims, count(*) FILTER (n > 1) AS shared FROM cited JOIN n USING (claim) GROUP BY 1""",
}
