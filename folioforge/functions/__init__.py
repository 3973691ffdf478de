"""folioforge functions."""
