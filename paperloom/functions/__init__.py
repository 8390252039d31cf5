"""Column functions: no UDFs, so all of them stay in generated code."""
