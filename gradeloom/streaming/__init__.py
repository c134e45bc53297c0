"""Structured Streaming jobs. Both run to the end of the available input and stop."""
