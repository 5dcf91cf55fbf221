"""Registered queries with their SQL, by group."""
