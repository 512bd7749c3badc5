"""Audit of labelled entity-pair benchmarks as Spark jobs."""
