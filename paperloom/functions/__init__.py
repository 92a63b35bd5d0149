"""Column expressions: text normalisation, hashing, naming, scoring, highlighting."""
