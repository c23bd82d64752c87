"""Registered queries, their input adapters and SQL twins."""
