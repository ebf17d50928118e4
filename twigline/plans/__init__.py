"""Plans: selectors to Catalyst expressions (row-local) or to joins of element tables."""
