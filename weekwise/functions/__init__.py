"""Column and aggregate helpers, all of them built-in expressions."""
