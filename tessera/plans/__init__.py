"""Derived rasters, sessions and whole runs."""
