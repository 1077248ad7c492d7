"""Reusable DataFrame operators: windows, keep-first, exact ranks, aggregates."""
