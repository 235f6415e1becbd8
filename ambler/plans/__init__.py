"""Intermediate tables, fixture graphs and the query catalog."""
