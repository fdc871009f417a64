"""Reading, validating and maintaining tables."""
