"""folioforge plans."""
