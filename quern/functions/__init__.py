"""Column expressions, and the few functions that need Python."""
