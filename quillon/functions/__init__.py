"""Column functions: hashes, strings, time of day, type codes."""
