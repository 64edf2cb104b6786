"""Structured Streaming forms of the activity, alert and request operators."""
