"""Operators on the rows of the two tiers."""
