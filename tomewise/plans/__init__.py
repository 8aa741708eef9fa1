"""Whole jobs composed of operators, the query registry and its SQL checks."""
