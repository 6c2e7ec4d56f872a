"""Registered queries over the star-schema files and their SQL equivalents."""
