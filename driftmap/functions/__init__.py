"""Column functions: geometry, expiry, cells, sharding, identifiers."""
