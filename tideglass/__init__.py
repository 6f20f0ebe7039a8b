"""tideglass: a Spark-first analytics engine for market and research data."""
