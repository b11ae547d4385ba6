"""Reports composed from operators."""
