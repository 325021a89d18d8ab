"""Readers of tables and elevation tiles."""
