"""Subpackage of lexloom."""
