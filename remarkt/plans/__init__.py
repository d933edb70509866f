"""Whole jobs made of the operators and functions."""
