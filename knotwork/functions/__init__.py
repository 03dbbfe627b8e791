"""Subpackage of knotwork."""
