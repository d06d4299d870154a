"""Column expressions: domain formulas, recoding and tail probabilities."""
