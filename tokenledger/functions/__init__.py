"""Column expressions: dimensions, time windows, tickets, paths, labels."""
