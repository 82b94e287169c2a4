"""Registered queries: each operator family applied to the driver's tables, with the same question in SQL."""
