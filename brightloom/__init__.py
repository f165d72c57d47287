"""brightloom: Spark-native analytics over documents, vectors, conversations and metrics."""
