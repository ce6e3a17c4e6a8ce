"""Column expressions and small per-group kernels."""
