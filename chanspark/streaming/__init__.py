"""Stateful and continuous operators."""
