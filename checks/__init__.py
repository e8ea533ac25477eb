"""Queries over the generated tables, each with the SQL that must give the same rows."""
