"""Queries: the operators applied to whole tables, with the SQL that must give the same rows."""
