"""Change events on Structured Streaming."""
