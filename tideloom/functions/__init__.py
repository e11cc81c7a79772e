"""Column-level building blocks: calendar arithmetic, series arrays, error measures."""
