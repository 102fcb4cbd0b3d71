"""Relational operators, each a DataFrame-to-DataFrame function."""
