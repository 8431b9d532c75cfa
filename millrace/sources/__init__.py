"""Readers and writers: column files, JSON lines, token streams, key-value stores, batches by size."""
