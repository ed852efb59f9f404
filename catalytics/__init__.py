"""catalytics — catalog demand analytics as Spark DataFrame jobs.

Layout:
  sources/    driver tables, derived fixtures (catalog, listings, orders, ...),
              typed readers and sinks
  functions/  column expressions: scores, levels, labels, predicates, parsing
  operators/  DataFrame -> DataFrame jobs: aggregates, ranking, joins,
              sampling, machine learning, change-log merges
  plans/      named queries (the registry used by __spark_entry__) and
              their DuckDB oracle SQL
  streaming/  Structured Streaming jobs (order ingest, tumbling units)
"""

from catalytics.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
