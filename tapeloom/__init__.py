"""tapeloom: market-tape analytics expressed as Spark DataFrames."""
