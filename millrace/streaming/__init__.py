"""Structured Streaming: run logs, file exchanges, windows and keyed state."""
