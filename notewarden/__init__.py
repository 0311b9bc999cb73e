"""Spark-native redaction, extraction and pathway-variance over tables of documents."""
