"""Column expressions shared by every plan."""
