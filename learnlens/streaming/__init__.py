"""The refresh as a stream."""
