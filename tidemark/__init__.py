"""tidemark: Spark jobs that follow topics through timestamped text."""
