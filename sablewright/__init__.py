"""Sablewright: a Spark-native engine for research-literature retrieval, evidence resolution and corpus preparation."""
