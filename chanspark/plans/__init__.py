"""Registered queries and experiment plans."""
