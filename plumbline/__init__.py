"""plumbline: Spark jobs that build, prune, rank and judge multiple-choice decisions."""
