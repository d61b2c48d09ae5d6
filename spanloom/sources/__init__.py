"""Readers of landed change data. Parsers run inside tasks, one text at a time, and emit rows."""
