"""Whole plans, put together from the operators."""
