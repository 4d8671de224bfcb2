"""Reading files and tables, and writing tables."""
