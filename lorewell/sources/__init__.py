"""Reading and writing assertions and dialogue files."""
