"""Korvane: filtered vector retrieval and its supporting batch jobs as Spark plans."""
