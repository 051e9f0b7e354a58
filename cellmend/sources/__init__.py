"""What is read and written: tables, constraint files, graph files."""
