"""Structured Streaming: the cascade as a stateless append stream."""
