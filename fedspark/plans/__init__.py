"""Queries over the tables, by name, each with SQL that says the same."""
