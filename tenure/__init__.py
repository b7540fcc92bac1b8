"""Find and repair missing owners in account relations, as Spark jobs."""
