"""loomwright: declaratively built data models on Spark DataFrames."""
