"""Scalar functions over columns; Python only where a built-in expression cannot say it (token alignment)."""
