"""Shared logical plans."""
