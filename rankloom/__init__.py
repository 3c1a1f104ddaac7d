"""rankloom: document screening, ranking and vector search as Spark jobs."""
