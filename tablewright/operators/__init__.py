"""Subpackage of tablewright."""
