"""Claims audit on Spark DataFrames: billed work checked against its evidence."""
