"""Operators that prepare training text: one module for each, queries in ``queries``."""
