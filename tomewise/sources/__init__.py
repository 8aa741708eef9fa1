"""Readers, writers and the input views derived from the supplied tables."""
