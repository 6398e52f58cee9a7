"""Readers: the raw tables and the editorial views over them."""
