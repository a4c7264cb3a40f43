"""Declarations and the plans derived from schemas and catalog listings."""
