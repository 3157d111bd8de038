"""fedspark: federated and privacy-aware machine-learning data flows on Spark DataFrames."""
