"""Corpus retrieval and analytics on Spark: chunks, keyword and vector search, links, metering."""
