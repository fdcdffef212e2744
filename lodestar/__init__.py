"""lodestar: hybrid retrieval, ranking and search analytics as Spark DataFrame transformations."""
