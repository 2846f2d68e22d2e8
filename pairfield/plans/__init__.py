"""Registered queries over the reference tables."""
