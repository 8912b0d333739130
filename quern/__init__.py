"""A Spark-native engine for building, auditing and exploring text training corpora."""
