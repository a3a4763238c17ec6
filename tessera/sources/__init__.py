"""Panel files and generators."""
