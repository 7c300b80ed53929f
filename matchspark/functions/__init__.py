"""Column functions and small helpers that run inside tasks."""
