"""Plumbline: figure-curation analytics on Spark."""
