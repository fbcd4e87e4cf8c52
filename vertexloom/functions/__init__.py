"""Column expressions and array kernels without a plan of their own."""
