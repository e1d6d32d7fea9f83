"""Column expressions and statistical distributions."""
