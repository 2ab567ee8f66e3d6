"""Column-level helpers: type families, parameters, stable hashing."""
