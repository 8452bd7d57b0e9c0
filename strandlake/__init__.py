"""A Spark-native engine for per-read current signals, event runs and k-mer models."""
