"""Operators: tables in, tables out."""
