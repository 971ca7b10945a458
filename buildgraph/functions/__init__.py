"""Column expressions and skew-safe building blocks used by the operators."""
