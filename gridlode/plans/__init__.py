"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and the same in SQL for the checks."""

from . import cells, documents, planned, relations, versions

QUERIES = {**cells.QUERIES, **relations.QUERIES, **versions.QUERIES, **documents.QUERIES, **planned.QUERIES}
ORACLE_SQL = {**cells.SQL, **relations.SQL, **versions.SQL, **documents.SQL, **planned.SQL}
