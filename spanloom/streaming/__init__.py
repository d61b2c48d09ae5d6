"""Structured Streaming forms of state that the batch engine rebuilds: two-way review sync and latest-run-wins."""
