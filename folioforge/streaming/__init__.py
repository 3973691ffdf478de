"""folioforge streaming."""
