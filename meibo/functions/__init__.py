"""Column expressions: text normalisation, cell fixes and cell checks."""
