"""Live turns."""
