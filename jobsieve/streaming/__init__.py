"""The recurring ingest as Structured Streaming."""
