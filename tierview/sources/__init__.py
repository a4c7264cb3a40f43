"""Catalog objects: tables, partitions, cold sources, views."""
