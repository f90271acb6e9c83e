"""Memory analytics on Spark: record predicates, scoring, joins, ledgers, graphs and reports as DataFrames."""
