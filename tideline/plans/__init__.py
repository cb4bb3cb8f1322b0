"""Pipelines of named steps, and rows that compile into them."""
