"""FITS, PNG and report writers."""
