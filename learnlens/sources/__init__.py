"""Readers, extracts of the flattened tables, and the snapshot and refresh jobs."""
