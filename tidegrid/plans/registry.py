"""All queries of the core, and their SQL."""

from __future__ import annotations

from tidegrid.plans import io_queries, pipeline_queries, pipeline_sql, spatial_queries, spatial_sql, stream_queries

FLAGSHIP = "range_pt_pt"


def queries() -> dict:
    return {**spatial_queries.QUERIES, **io_queries.QUERIES, **stream_queries.QUERIES, **pipeline_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**spatial_sql.SQL, **io_queries.SQL, **stream_queries.SQL, **pipeline_sql.SQL}
