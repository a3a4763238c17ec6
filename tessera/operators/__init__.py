"""Operators on panels, cells and seams."""
