"""Operators on whole relations."""
