"""Column expressions; every function returns a lazy Column."""
