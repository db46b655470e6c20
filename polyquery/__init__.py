"""polyquery: property-graph queries, vector search, versioned key-value logs,
collections, budgets and sketches, all as Spark DataFrames."""
