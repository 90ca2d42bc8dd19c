"""Column expressions: everything here is a built-in expression tree, no UDFs."""
