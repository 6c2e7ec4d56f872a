"""DataFrame operators, grouped by what they answer."""
