"""Column functions of the retrieval engine: plain Spark expressions."""
