"""Column expressions: Column(s) in, Column out."""
