"""Column functions: kernels as Arrow-batched UDFs, and mathematics from built-in functions."""
