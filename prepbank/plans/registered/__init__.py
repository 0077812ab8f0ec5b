"""Queries over the given tables, each beside the SQL that must give the same rows."""
