"""Operators on unbounded order lines."""
