"""Column expressions and Arrow kernels that operators are made of."""
