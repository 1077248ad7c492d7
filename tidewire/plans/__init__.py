"""Whole analyses put together from the functions and operators."""
