"""A Spark-first static-analysis and corpus-processing engine."""
