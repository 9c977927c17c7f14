"""gridloom: labelled-grid analytics and corpus preparation on Spark DataFrames."""
