"""An analytics engine for software-engineering data on Spark DataFrames."""
