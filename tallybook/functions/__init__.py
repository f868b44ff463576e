"""Column expressions and small aggregates shared by the operators."""
