"""Row-level functions: Columns in, a Column out."""
