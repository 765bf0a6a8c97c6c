"""Readers, writers and the feeds derived from the benchmark tables."""
