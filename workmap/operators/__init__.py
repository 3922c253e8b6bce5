"""Relational operators, generic over column names."""
