"""Operators for preparing large text corpora; see ``queries`` for what is registered."""
