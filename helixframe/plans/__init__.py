"""Registered queries: operators put together over the given tables, with their SQL."""
