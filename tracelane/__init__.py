"""Spark-native analytics over request records, workload traces and latency measurements."""
