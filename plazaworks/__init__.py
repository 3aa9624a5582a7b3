"""Community matching and knowledge search as Spark jobs."""
