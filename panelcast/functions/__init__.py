"""Column-level building blocks: they take and return Columns, or small dimension frames."""
