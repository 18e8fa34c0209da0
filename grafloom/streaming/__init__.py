"""Structured Streaming forms of the job log, the rate windows, the routing of events, and re-indexing."""
