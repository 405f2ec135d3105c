"""Incremental use of the operators on Structured Streaming sources."""
