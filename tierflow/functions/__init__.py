"""Column expressions: text rules and costs."""
