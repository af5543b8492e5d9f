"""Edit plans as tables."""
