"""loam: line-level dataset building, auditing and evaluation as Spark jobs."""
