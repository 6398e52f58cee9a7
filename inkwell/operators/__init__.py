"""Relational operators on any DataFrame."""
