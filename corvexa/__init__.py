"""corvexa: a Spark-first analytics engine built on DataFrames, SQL and Catalyst."""
