"""Operators for building training corpora, each a Spark job over whole tables."""
