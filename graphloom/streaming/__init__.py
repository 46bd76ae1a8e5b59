"""Structured Streaming: diagnostics as they arrive, and windows over events."""
