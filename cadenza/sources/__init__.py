"""Scans and sinks: interactions, results log, persisted models, test fixtures."""
