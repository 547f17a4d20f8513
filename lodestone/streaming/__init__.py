"""Streaming maintenance of the chunk store. It goes beyond batch ingest and is optional."""
