"""The Structured Streaming form of the feature engine."""
