"""Incremental summaries over streams of row strips."""
