"""All queries of the core."""

from stelae.plans import admission_queries, graph_queries, identity_queries, reading_queries, relation_queries, tables_queries, workspace_queries

FLAGSHIP = "corroborated_claims"
_MODULES = (tables_queries, identity_queries, admission_queries, graph_queries, reading_queries, relation_queries, workspace_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
