"""churnlens: customer-retention analytics as distributed Spark DataFrame operators.

Layers:
  sources/    table loading (CSV loader, driver-table binding), sinks
  functions/  column-level helpers (exact rounding, month math, rule lists)
  operators/  the analytical operators (cohorts, funnel, RFM, profiling, ranking)
  plans/      the registered query catalogue and its DuckDB oracle SQL
  streaming/  nothing: the analyses are batch-only (see README)
"""

__version__ = "0.1.0"
