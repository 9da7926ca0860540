"""Named questions and the given tables in their words."""
