"""Registered queries: one module for each family of operators."""
