"""folioforge operators."""
