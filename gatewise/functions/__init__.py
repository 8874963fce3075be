"""Column-level building blocks (no DataFrame operations)."""
