"""Readers, writers, declared schemas and the views over the benchmark tables."""
