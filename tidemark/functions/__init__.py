"""Column expressions: predicates, fixers and coercions."""
