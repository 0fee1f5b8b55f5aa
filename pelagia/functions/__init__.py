"""Column expressions for cleaning values, times, paths and positions."""
