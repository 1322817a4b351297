"""Plans over the given tables."""
