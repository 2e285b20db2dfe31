"""planforge: declarative relational plans compiled to Spark DataFrames."""
