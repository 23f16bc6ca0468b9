"""Shared plan shapes: blocked running totals, blocked top-k, scratch folders."""
