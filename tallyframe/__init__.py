"""tallyframe: Spark-native table reconciliation, profiling, type advice and migration."""
