"""Column expressions: no function in this layer moves data."""
