"""Column -> Column building blocks; every function compiles to native expressions."""
