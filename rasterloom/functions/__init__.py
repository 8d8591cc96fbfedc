"""Column expressions: value cleaning, georeferencing, neighbourhood kernels."""
