"""Fields that arrive frame by frame (Structured Streaming)."""
