"""Inputs: the five CSV tables, or the same tables derived from an order-line schema."""
