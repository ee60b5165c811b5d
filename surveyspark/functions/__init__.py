"""Column expressions: recodes, derivations, weights and ratios."""
