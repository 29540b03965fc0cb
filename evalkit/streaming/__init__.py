"""Structured Streaming use of the same operators (the reference has no streaming;
scoring is stateless per row, so it runs unchanged on a stream)."""
