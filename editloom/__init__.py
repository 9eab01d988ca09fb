"""A Spark-native engine that calls genome edits from amplicon reads."""
