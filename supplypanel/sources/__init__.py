"""Where data comes from and where results go."""
