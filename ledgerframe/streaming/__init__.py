"""Change feeds and streaming upserts on Structured Streaming."""
