"""folioforge sources."""
