"""Composite pipelines made of the operators."""
