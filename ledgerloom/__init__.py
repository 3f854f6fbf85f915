"""ledgerloom: evidence analytics and record linkage for Spark DataFrames."""
