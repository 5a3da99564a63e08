"""Contact-record cleaning and data-processing engine on Spark DataFrames."""
