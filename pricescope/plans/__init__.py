"""Queries by name, with the SQL that each is held against."""
