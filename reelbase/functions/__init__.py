"""Column functions: bytes, text and code tables."""
