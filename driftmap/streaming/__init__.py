"""Live positions and change feeds with Structured Streaming."""
