"""Column functions: hashes for reproducible draws, ranks without a single-task sort, small vector algebra."""
