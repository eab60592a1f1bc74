"""Records engine: listing records, their history and their texts as Spark DataFrames."""
