"""Column expressions: every function takes and returns Columns, and needs no shuffle."""
