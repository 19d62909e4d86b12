"""siteloom: variant-call analytics expressed as Spark DataFrames."""
